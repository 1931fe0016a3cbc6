"""Operator 8: line deduplication by an exact set-similarity join.

A line's tokens are its shingles of five words (its whole word sequence if it is
shorter), letters A-Z lower-cased. A line goes if an earlier line, by document id,
row and line number, has a Jaccard similarity of at least the threshold to it.

Equal lines are found by a key. Among different lines, tokens are ordered by
rarity, and a line is indexed under its prefix alone: similar lines must share a
token there. Length and position rule most pairs out before the token sets are
compared. Of a token that many lines share, each line is first compared with the
earliest of them, so that groups of copies need no comparison of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bucket_count, discard, materialize, numbered, row_order
from .components import connected_components
from .simhash import MOST_BITS, close_links

SHINGLE_WORDS = 5
PERCENT = 80
#: Frequent tokens with a rank of their own; all others count as rare. The order
#: of tokens decides how much is compared, never what is found.
RANKED_TOKENS = 65_536
#: A token repeated so often within a batch of documents is reported for ranking.
REPORTED = 4
#: Bits of a token, and lines whose tokens are sorted at once: 64 bits together.
TOKEN_BITS = 52
LINES_AT_ONCE = 1 << (64 - TOKEN_BITS)
#: Prefix rows travel in blobs of one range of tokens. A task sorts so many rows
#: into blobs at once, a blob holds so many at most, and there are as many ranges
#: as keep the expected rows of one near the third figure.
ROWS_AT_ONCE = 250_000
BLOB_ROWS = 2_000
RANGE_ROWS = 200_000
#: A range that has come to hold so many times its expected rows hands on, as they
#: are, the tokens that fill it: whatever is shared that often needs no filter.
RANGE_SLACK = 4
#: The filter of lines that may have a partner has 16 bits a line, up to a bound
#: that can be broadcast: beyond it more lines pass, and none is lost.
LEAST_FILTER_BITS, MOST_FILTER_BITS = 1 << 20, 1 << 30
SEGMENT_BITS = 1 << 20
COLLECTED_BITS = 1 << 27
#: Bytes of text analysed at once; longer texts are cut between lines.
CHUNK_BYTES = 1 << 18
#: Keys of more than one line in so many are joined by broadcast: fewer keys than that.
HOT_SHARE = 4096

#: Words of 64 parity bits that tell long token sets apart, of documents.
SKETCH_WORDS = 64

PARITY = ["p0", "p1", "p2", "p3"]
_RANKED = np.uint64(1) << np.uint64(TOKEN_BITS - 1)
_odd = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1) for k in range(SHINGLE_WORDS)]
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2^64
_CHECK = 0xC2B2AE3D27D4EB4E  # even, so that what it flips stays odd
_SPREAD = 0x9E3779B97F4A7C15
_TOKEN_MASK = np.uint64((1 << TOKEN_BITS) - 1)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Lines:
    """The lines of some texts: doc, number, words (their count), key, and the
    hashes of all words, one line after the other. Letters A-Z are lower-cased
    and words end at ASCII blanks; equal word sequences have equal keys. If
    ``checked``, check is a second 64-bit number of the word sequence.
    """

    _up = _powers(_BASE, CHUNK_BYTES * 2)
    _down = _powers(pow(_BASE, -1, 1 << 64), CHUNK_BYTES * 2)

    def __init__(self, pieces: list[tuple[int, int, bytes]], checked: bool = False):
        raw = np.frombuffer(b"\n".join(p for _, _, p in pieces) + b"\n", np.uint8)
        n = len(raw)
        if n > len(Lines._up):
            Lines._up, Lines._down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        per = np.array([p.count(b"\n") + 1 for _, _, p in pieces], np.int64)
        self.doc = np.repeat(np.array([d for d, _, _ in pieces], np.int64), per)
        self.number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(np.array([k for _, k, _ in pieces], np.int64), per)
        blank = _BLANK[raw]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if n and not blank[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[0::2], edge[1::2]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * Lines._up[:n], dtype=np.uint64)])
        self.hashes = _mix((total[end] - total[start]) * Lines._down[start])
        upto = np.searchsorted(start, np.flatnonzero(raw == 10))
        self.words = np.diff(upto, prepend=0)
        first = upto - self.words
        within = np.arange(len(start)) - np.repeat(first, self.words)
        odd = (np.uint64(2) * within.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(self.hashes ^ odd), dtype=np.uint64)])
        key = sums[first + self.words] - sums[first]
        self.first = first
        self.key = _mix(key + self.words.astype(np.uint64)).view(np.int64)
        if checked:
            more = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * (odd ^ np.uint64(_CHECK)), dtype=np.uint64)])
            self.check = _mix(more[first + self.words] - more[first]).view(np.int64)

    def looped(self) -> np.ndarray:
        """Whether a line has one word twice within a distance of three."""
        out, line_end = np.zeros(len(self.words), bool), self.first + self.words
        for d in (1, 2, 3):
            at = np.flatnonzero(self.hashes[:-d] == self.hashes[d:])
            line = np.searchsorted(line_end, at, "right")
            out[line[at + d < line_end[line]]] = True
        return out


def chunks(texts: list, checked: bool = False) -> Iterator[Lines]:
    """Lines of all texts, about CHUNK_BYTES at a time; doc is the text's place."""
    pieces, size = [], 0
    for i, text in enumerate(texts):
        if text is None:
            continue
        raw, at, number = text.encode().lower(), 0, 0
        while True:
            cut = len(raw)
            if cut - at > CHUNK_BYTES:
                cut = raw.rfind(b"\n", at, at + CHUNK_BYTES)
                cut = cut if cut >= 0 else raw.find(b"\n", at)
                cut = cut if cut >= 0 else len(raw)
            pieces.append((i, number, raw[at:cut]))
            size += cut - at
            if size >= CHUNK_BYTES or len(pieces) >= 4 * LINES_AT_ONCE:
                yield Lines(pieces, checked)
                pieces, size = [], 0
            if cut >= len(raw):
                break
            number += raw.count(b"\n", at, cut) + 1
            at = cut + 1
    if pieces:
        yield Lines(pieces, checked)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values and how often each stands there."""
    x = np.sort(x)
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[start], np.diff(np.concatenate([start, [len(x)]]))


class Tokenizer:
    """Token sets of lines, as sorted arrays of TOKEN_BITS-bit numbers. A token is
    a shingle of ``width`` words, five at most."""

    def __init__(self, ranked: list[int] | None = None, width: int = SHINGLE_WORDS):
        self.width = width
        hashes = np.array([] if ranked is None else ranked, np.uint64)
        self._order = np.argsort(hashes)
        self._ranked = hashes[self._order]
        self._hint = np.zeros(1 << 20, bool)
        self._hint[hashes & np.uint64((1 << 20) - 1)] = True

    @staticmethod
    def shingles(lines: Lines, pick: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """The line (a place in ``pick``) and the hash of every shingle."""
        sizes = lines.words[pick]
        starts = (np.cumsum(lines.words) - lines.words)[pick]
        n = np.where(sizes > 0, np.maximum(sizes - width + 1, 1), 0)
        line = np.repeat(np.arange(len(pick)), n)
        h, total = lines.hashes, len(lines.hashes)
        mixed = np.zeros(len(line), np.uint64)
        if total >= width:  # all runs of so many words, then those within a line
            runs = h[: total - width + 1] * _odd[0]
            for k in range(1, width):
                runs += h[k : total - width + 1 + k] * _odd[k]
            at = np.arange(len(line)) + np.repeat(starts - (np.cumsum(n) - n), n)
            mixed = runs[np.minimum(at, len(runs) - 1)]
        short = np.flatnonzero((sizes > 0) & (sizes < width))
        if len(short):
            part = np.zeros(len(short), np.uint64)
            for k in range(width - 1):
                part += np.where(sizes[short] > k, h[np.minimum(starts[short] + k, total - 1)] * _odd[k], np.uint64(0))
            mixed[(np.cumsum(n) - n)[short]] = part
        return line, _mix(mixed) >> np.uint64(64 - TOKEN_BITS + 1)

    def sets(self, lines: Lines, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The line and the token of every different token, rarest first in a line.

        ``pick`` holds LINES_AT_ONCE lines at most. A ranked token is its rank
        with the top bit set, so it sorts after all others, and a rarer one
        before a more frequent one.
        """
        line, token = self.shingles(lines, pick, self.width)
        if len(self._ranked) and len(token):
            maybe = np.flatnonzero(self._hint[token & np.uint64(len(self._hint) - 1)])
            i = np.minimum(np.searchsorted(self._ranked, token[maybe]), len(self._ranked) - 1)
            known = self._ranked[i] == token[maybe]
            rank = (len(self._ranked) - 1 - self._order[i[known]]).astype(np.uint64)
            token[maybe[known]] = _RANKED | rank
        both = np.sort((line.astype(np.uint64) << np.uint64(TOKEN_BITS)) | token)
        if len(both):
            both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        return (both >> np.uint64(TOKEN_BITS)).astype(np.int64), both & ((np.uint64(1) << np.uint64(TOKEN_BITS)) - np.uint64(1))


def _key_rows(rows: DataFrame, percent: int) -> DataFrame:
    """Lines with a word (row, id, line, key, check) and reports (token, n): how
    often a frequent token stands in a batch and, as token -1, its prefix rows."""
    id_type = rows.schema["_id"].dataType.simpleString()
    names = ["_rid", "_id", "line", "key", "check", "token", "n"]

    def run(batches):
        for b in batches:
            for lines in chunks(b.column(2).to_pylist(), checked=True):
                some = np.flatnonzero(lines.words > 0)
                n = len(some)
                doc = pa.array(lines.doc[some])
                yield pa.RecordBatch.from_arrays([b.column(0).take(doc), b.column(1).take(doc), pa.array(lines.number[some].astype(np.int32)), pa.array(lines.key[some]), pa.array(lines.check[some]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
                token, count = _runs(Tokenizer.shingles(lines, some)[1])
                often = count >= REPORTED
                whole = prefix_length(np.maximum(lines.words[some] - SHINGLE_WORDS + 1, 0), percent)
                token, count = np.append(token[often].astype(np.int64), -1), np.append(count[often], whole.sum())
                m = len(token)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, b.column(1).type), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(token), pa.array(count)], names)

    return rows.select("_rid", "_id", "_text").mapInArrow(run, f"_rid long, _id {id_type}, line int, key long, check long, token long, n long")


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def _prefixes(tok: Tokenizer, texts: list, percent: int):
    """token, key, n (tokens of the line) and pos of the prefix tokens of lines."""
    for lines in chunks(texts):
        some = np.flatnonzero(lines.words >= SHINGLE_WORDS)
        some = some[np.unique(lines.key[some], return_index=True)[1]] if len(some) else some
        looped = lines.looped()
        for lo in range(0, len(some), LINES_AT_ONCE):
            pick = some[lo : lo + LINES_AT_ONCE]
            line, token = tok.sets(lines, pick)
            n = np.bincount(line, minlength=len(pick))
            pos = np.arange(len(line)) - (np.cumsum(n) - n)[line]
            # No different line has the one token of a line shorter than a shingle.
            # A line of so few tokens that only an equal set is similar has no
            # partner either, unless its shingles can follow each other in another
            # order: then one starts where an earlier one ends, three words back
            # at most, and a word is repeated at that distance.
            alone = (n <= 3) & (100 * n < percent * (n + 1)) & (n == lines.words[pick] - SHINGLE_WORDS + 1) & ~looped[pick]
            use = (pos < prefix_length(n, percent)[line]) & ~alone[line]
            line = line[use]
            yield token[use], lines.key[pick][line], n[line], pos[use]


def _packed(cols: list[np.ndarray]) -> bytes:
    """A blob of rows: steps of place and the keys, lengths and positions, byte by
    byte of all rows, so that the bytes that are mostly zero lie together."""
    place, key, n, pos = cols
    order = np.argsort(place, kind="stable")
    step = np.diff(place[order], prepend=np.uint64(0))
    parts = (step.astype("<u8"), key[order].astype("<i8"), n[order].astype("<u4"), pos[order].astype("<u4"))
    return b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in parts)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    k, at, out = len(blob) // 24, 0, []
    for kind, width in (("<u8", 8), ("<i8", 8), ("<u4", 4), ("<u4", 4)):
        planes = np.frombuffer(blob, np.uint8, k * width, at).reshape(width, k)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += k * width
    return [np.cumsum(out[0], dtype=np.uint64), out[1], out[2].astype(np.int64), out[3].astype(np.int64)]


def _joined(parts: list) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts)]


def _prefix_blobs(docs: DataFrame, text_col: str, ranked, percent: int, ranges: int, width: int = SHINGLE_WORDS, prefixes=None) -> DataFrame:
    """Prefix rows as blobs of one range (r) of tokens, a token as its place in
    an order that mixes frequent tokens among the others."""
    prefixes = prefixes or _prefixes

    def flush(held):
        token, *rest = _joined(held)
        place = (token * np.uint64(_SPREAD)) & _TOKEN_MASK
        r = ((place >> np.uint64(20)) * np.uint64(ranges)) >> np.uint64(TOKEN_BITS - 20)
        order = np.argsort(r.astype(np.uint32), kind="stable")
        r, cols = r[order], [c[order] for c in (place, *rest)]
        starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        which, blobs = [], []
        for lo, end in zip(starts.tolist(), [*starts[1:].tolist(), len(r)]):
            for a in range(lo, end, BLOB_ROWS):
                which.append(int(r[a]))
                blobs.append(_packed([c[a : min(a + BLOB_ROWS, end)] for c in cols]))
        return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(blobs, pa.binary())], ["r", "blob"])

    def run(batches):
        tok, held, size = Tokenizer(ranked.value, width), [], 0
        for b in batches:
            for found in prefixes(tok, b.column(0).to_pylist(), percent):
                held.append(found)
                size += len(found[0])
                if size >= ROWS_AT_ONCE:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return docs.select(text_col).mapInArrow(run, "r int, blob binary")


def _fits(n1, p1, n2, p2, percent):
    """Length and positional filter of two rows of one token."""
    need = -(-percent * (n1 + n2) // (100 + percent))
    return (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & (np.minimum(n1 - p1, n2 - p2) >= need)


def _settled(t, k, n, p, percent):
    """Of some tokens' rows those that another row of the token fits, copies once."""
    order = np.argsort(t, kind="stable")
    t = t[order]
    again = np.flatnonzero(t[1:] == t[:-1])
    some = np.zeros(len(t), bool)
    some[again] = some[again + 1] = True
    t, order = t[some], order[some]
    k, n, p = k[order], n[order], p[order]
    order = np.lexsort((k, t))
    t, k, n, p = t[order], k[order], n[order], p[order]
    if not len(t):
        return t, k, n, p
    first = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
    t, k, n, p = t[first], k[first], n[first], p[first]  # copies of a line from several tasks
    start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    size = np.diff(np.concatenate([start, [len(t)]]))
    keep = np.zeros(len(t), bool)
    two = start[size == 2]
    both = two[_fits(n[two], p[two], n[two + 1], p[two + 1], percent)]
    keep[both] = keep[both + 1] = True
    for s, c in zip(start[size > 2].tolist(), size[size > 2].tolist()):
        if c <= 32:
            a, b = n[s : s + c], p[s : s + c]
            fit = _fits(a[:, None], b[:, None], a, b, percent)
            np.fill_diagonal(fit, False)
            keep[s : s + c] = fit.any(1)
            continue
        combos, index, count = np.unique(np.stack([n[s : s + c], p[s : s + c]], 1), axis=0, return_inverse=True, return_counts=True)
        ok = np.zeros(len(combos), bool)
        for i, (a, b) in enumerate(combos):
            fit = _fits(a, b, combos[:, 0], combos[:, 1], percent)
            fit[i] &= count[i] > 1
            ok[i] = fit.any()
        keep[s : s + c] = ok[index.reshape(-1)]
    return t[keep], k[keep], n[keep], p[keep]


def _shared_rows(percent: int, most: int):
    """Of blobs sorted by range, the prefix rows that another row of the token fits.

    One range is held at a time. If it comes to more than ``most`` rows, the
    tokens with the most rows go on unjudged, and so do their later rows.
    """
    back = np.uint64(pow(_SPREAD, -1, 1 << TOKEN_BITS))

    def rows(found):
        place, *rest = found
        token = (place * back) & _TOKEN_MASK
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (token, *rest)], ["token", "key", "n", "pos"])

    def run(batches):
        now, held, size, heavy, limit = None, [], 0, np.zeros(0, np.uint64), most
        for b in batches:
            for r, blob in zip(b.column(0).to_pylist(), b.column(1)):
                if r != now:
                    if held:
                        yield rows(_settled(*_joined(held), percent))
                    now, held, size, heavy, limit = r, [], 0, np.zeros(0, np.uint64), most
                cols = _unpacked(blob.as_py())
                if len(heavy):
                    out = np.isin(cols[0], heavy)
                    yield rows([c[out] for c in cols])
                    cols = [c[~out] for c in cols]
                held.append(cols)
                size += len(cols[0])
                if size > limit:
                    cols = _joined(held)
                    place, count = _runs(cols[0])
                    by = np.argsort(-count, kind="stable")
                    top = place[by[: int(np.searchsorted(np.cumsum(count[by]), size // 2)) + 1]]
                    if len(top) * 64 < size:  # few tokens fill the range
                        heavy = np.concatenate([heavy, top])
                        out = np.isin(cols[0], top)
                        yield rows([c[out] for c in cols])
                        held = [[c[~out] for c in cols]]
                        size = int((~out).sum())
                    else:  # many tokens: the range is larger than was expected
                        held, limit = [cols], 2 * size
        if held:
            yield rows(_settled(*_joined(held), percent))

    return run


def _key_filter(keys: DataFrame, bits: int) -> bytes:
    """A Bloom filter of keys: ``bits`` packed bits, built in segments."""

    def mark(batches):
        for b in batches:
            place = np.unique(np.concatenate([x for x in _places(b.column(0).to_numpy(), bits)]))
            seg = (place // np.uint64(SEGMENT_BITS)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(seg) else []
            inner = (place % np.uint64(SEGMENT_BITS)).astype("<u4")
            ends = [*starts[1:], len(seg)]
            yield pa.RecordBatch.from_arrays([pa.array([int(seg[i]) for i in starts], pa.int32()), pa.array([inner[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary())], ["seg", "at"])

    def merge(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for seg, at in zip(*(c.to_pylist() for c in b.columns)):
                found.setdefault(seg, np.zeros(SEGMENT_BITS, bool))[np.frombuffer(at, "<u4")] = True
        for seg, on in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], ["seg", "bits"])

    merged = keys.mapInArrow(mark, "seg int, at binary").repartition("seg").mapInArrow(merge, "seg int, bits binary")
    # MOST_FILTER_BITS bits at most; a small filter comes in one job, not one a partition.
    rows = merged.collect() if bits <= COLLECTED_BITS else merged.toLocalIterator()
    parts = {row["seg"]: row["bits"] for row in rows}
    return b"".join(parts.get(i, bytes(SEGMENT_BITS // 8)) for i in range(bits // SEGMENT_BITS))


def _places(keys: np.ndarray, bits: int):
    u = keys.view(np.uint64)
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
        yield ((u * np.uint64(odd)) >> np.uint64(30)) % np.uint64(bits)


def _sketches(line: np.ndarray, token: np.ndarray, lines: int) -> np.ndarray:
    """SKETCH_WORDS words of parity bits of each line's tokens."""
    bits = np.zeros(lines * SKETCH_WORDS * 64, bool)
    place = (token * np.uint64(0x165667B19E3779F9)) >> np.uint64(64 - (SKETCH_WORDS * 64 - 1).bit_length())
    at, count = _runs(line * (SKETCH_WORDS * 64) + place.astype(np.int64))
    bits[at[count % 2 == 1]] = True
    return np.packbits(bits).view(np.int64)


def _set_rows(docs: DataFrame, text_col: str, ranked, maybe, sketch: bool = False) -> DataFrame:
    """key, toks (its token set) and four words of parity bits of lines that the
    filter lets through. A token flips one of the 256 bits, so sets that share o
    of their n + m tokens differ in n + m - 2 o bits at most. With ``sketch`` n and
    a sketch of more such bits stand for the tokens.
    """
    kinds = {"n": "int", "sketch": "array<long>"} if sketch else {"toks": "array<long>"}

    def run(batches):
        tok = Tokenizer(ranked.value)
        bits = np.frombuffer(maybe.value, np.uint8)
        for b in batches:
            for lines in chunks(b.column(0).to_pylist()):
                some = np.flatnonzero(lines.words >= SHINGLE_WORDS)
                for place in _places(lines.key, 8 * len(bits)):
                    own = place[some]
                    some = some[(bits[own >> np.uint64(3)] >> (own & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                some = some[np.unique(lines.key[some], return_index=True)[1]] if len(some) else some
                for lo in range(0, len(some), LINES_AT_ONCE):
                    pick = some[lo : lo + LINES_AT_ONCE]
                    line, token = tok.sets(lines, pick)
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(line, minlength=len(pick)))])
                    place = (token * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(56)
                    flips = np.uint64(1) << (place & np.uint64(63))
                    parity = [np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == w, flips, np.uint64(0)), offsets[:-1]).view(np.int64) for w in range(4)]
                    if sketch:
                        cuts, flat = np.arange(len(pick) + 1) * SKETCH_WORDS, _sketches(line, token, len(pick))
                        own = [pa.array(np.diff(offsets).astype(np.int32)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat))]
                    else:
                        own = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(token.astype(np.int64)))]
                    yield pa.RecordBatch.from_arrays([pa.array(lines.key[pick]), *map(pa.array, parity), *own], ["key", *PARITY, *kinds])

    return docs.select(text_col).mapInArrow(run, ", ".join(f"{c} {t}" for c, t in ({"key": "long"} | dict.fromkeys(PARITY, "long") | kinds).items()))


def _sets_of(docs: DataFrame, text_col: str, ranked, keys: DataFrame, sketch: bool = False) -> DataFrame:
    """The token sets (or sketches) of the lines whose key is in ``keys``, written once."""
    count = keys.count()
    bits = min(max(1 << (16 * count).bit_length(), LEAST_FILTER_BITS), MOST_FILTER_BITS)
    maybe = docs.sparkSession.sparkContext.broadcast(_key_filter(keys, bits))
    buckets = bucket_count(count)
    made = _set_rows(docs, text_col, ranked, maybe, sketch).repartition(buckets, "key").dropDuplicates(["key"])
    wanted = keys.repartition(buckets, "key").distinct()
    return materialize(made.join(wanted.hint("merge"), "key", "left_semi"), "key", buckets)


def _fitting(a: DataFrame, b: DataFrame, percent: int, apart: bool = False) -> DataFrame:
    """Pairs late, early of lines with a common token that pass every filter,
    with the number of parity bits in which they differ; if ``apart``, of lines
    with different roots alone."""
    joined = a.alias("a").join(b.alias("b").hint("merge"), "token")
    n1, n2 = F.col("a.n"), F.col("b.n")
    need = F.ceil(F.lit(percent) * (n1 + n2) / F.lit(100 + percent))
    differ = sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in PARITY[1:]), F.bit_count(F.col("a.p0").bitwiseXOR(F.col("b.p0"))))
    fits = (F.col("a.ord") > F.col("b.ord")) & (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (F.least(n1 - F.col("a.pos"), n2 - F.col("b.pos")) >= need) & (n1 + n2 - differ >= 2 * need)
    if apart:
        fits = fits & (F.col("a.root") != F.col("b.root"))
    return joined.where(fits).select(F.col("a.key").alias("late"), F.col("b.key").alias("early"), differ.alias("differ")).distinct()


def _likeliest(pairs: DataFrame) -> DataFrame:
    """Of each late line the partner that differs least."""
    return pairs.groupBy("late").agg(F.min(F.struct("differ", "early")).alias("p")).select("late", "p.early", "p.differ")


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that their sketches don't rule out; differ is that of the sketches."""
    one = pairs.select("late", "early").join(sets.select(F.col("key").alias("early"), F.col("n").alias("n1"), F.col("sketch").alias("x")).hint("merge"), "early")
    two = one.join(sets.select(F.col("key").alias("late"), F.col("n").alias("n2"), F.col("sketch").alias("y")).hint("merge"), "late")
    bits = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda a, b: a + b)
    both = F.col("n1") + F.col("n2")
    return two.select("late", "early", bits.alias("differ"), both.alias("both")).where(F.col("both") - F.col("differ") >= 2 * F.ceil(F.lit(percent) * F.col("both") / F.lit(100 + percent))).drop("both")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs late, early whose Jaccard similarity suffices."""
    one = pairs.join(sets.select(F.col("key").alias("early"), F.col("toks").alias("x")).hint("merge"), "early")
    two = one.join(sets.select(F.col("key").alias("late"), F.col("toks").alias("y")).hint("merge"), "late")
    both = F.size(F.array_intersect("x", "y"))
    return two.where(both * (100 + percent) >= (F.size("x") + F.size("y")) * percent).select("late", "early")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The late lines (column key) of pairs whose Jaccard similarity suffices."""
    return _similar(pairs, sets, percent).select(F.col("late").alias("key")).distinct()


def _candidates(docs: DataFrame, text_col: str, first: DataFrame, ranked, expected: int, percent: int, sketch: bool = False) -> tuple[DataFrame, DataFrame]:
    """Prefix rows of lines that may have a partner, and the token sets (or
    sketches) of those lines."""
    ranges = min(max(64, expected // RANGE_ROWS), 1 << 20)
    most = RANGE_SLACK * max(RANGE_ROWS, expected // ranges)
    blobs = _prefix_blobs(docs, text_col, ranked, percent, ranges).repartition("r").sortWithinPartitions("r")
    found = materialize(blobs.mapInArrow(_shared_rows(percent, most), "token long, key long, n long, pos long").select("token", "key", F.col("n").cast("int").alias("n"), F.col("pos").cast("int").alias("pos")))
    sets = _sets_of(docs, text_col, ranked, found.select("key"), sketch)
    about = sets.select("key", *PARITY).join(first.hint("merge"), "key")
    buckets = bucket_count(found.count())
    rows = materialize(found.hint("merge").join(about, "key").repartition(buckets, "token"), "token", buckets)
    discard(found)
    return rows, sets


def _hubs(rows: DataFrame, *more: str) -> DataFrame:
    """Each token's earliest line."""
    return rows.groupBy("token").agg(F.min(F.struct("ord", "key", "n", "pos", *PARITY, *more)).alias("hub")).select("token", "hub.*")


def _near_keys(docs: DataFrame, text_col: str, first: DataFrame, ranked, expected: int, percent: int) -> DataFrame:
    """Keys of lines that have an earlier, different and similar line."""
    rows, sets = _candidates(docs, text_col, first, ranked, expected, percent)

    # One likely partner settles most lines: first each token's earliest line,
    # then any; only what is left is compared with all its partners.
    hub = _hubs(rows)
    settled = materialize(_verified(_likeliest(_fitting(rows, hub, percent)), sets, percent))
    pairs = materialize(_fitting(rows.join(settled, "key", "left_anti"), rows, percent))
    more = materialize(_verified(_likeliest(pairs), sets, percent))
    last = pairs.join(more.withColumnRenamed("key", "late"), "late", "left_anti").join(_likeliest(pairs), ["late", "early"], "left_anti")
    near = materialize(settled.unionByName(more).unionByName(_verified(last, sets, percent)).distinct())
    for done in (sets, rows, settled, pairs, more):
        discard(done)
    return near


def _near_links(docs: DataFrame, text_col: str, first: DataFrame, ranked, expected: int, percent: int) -> DataFrame:
    """Links a, b between the keys of different, similar lines, whose components
    are those of all such pairs. Every link is such a pair.
    """
    rows, sketches = _candidates(docs, text_col, first, ranked, expected, percent, sketch=True)

    def verified(pairs: DataFrame) -> DataFrame:
        """Tokens are read again for the few texts that sketches leave in pairs."""
        pairs = materialize(pairs.select("late", "early"))
        sets = _sets_of(docs, text_col, ranked, pairs.select(F.explode(F.array("late", "early")).alias("key")))
        out = materialize(_similar(pairs, sets, percent))
        discard(pairs)
        discard(sets)
        return out

    # Most groups are one component by their tokens' earliest lines already. Of
    # two rows of a token with different roots one is apart from the earliest.
    near = verified(_likeliest(_alike(_fitting(rows, _hubs(rows), percent), sketches, percent)))
    roots = connected_components(near.select(F.col("late").alias("a"), F.col("early").alias("b")))
    rooted = rows.join(roots.withColumnRenamed("v", "key").hint("merge"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    buckets = bucket_count(rows.count())
    placed = materialize(rooted.repartition(buckets, "token"), "token", buckets)
    apart = materialize(placed.join(_hubs(placed, "root").select("token", F.col("root").alias("hub")).hint("merge"), "token").where(F.col("root") != F.col("hub")).drop("hub"))
    pairs = _fitting(apart, placed, percent, apart=True).unionByName(_fitting(placed, apart, percent, apart=True)).distinct()
    links = near.unionByName(verified(_alike(pairs, sketches, percent))).select(F.col("late").alias("a"), F.col("early").alias("b"))
    for done in (rows, sketches, placed, apart):
        discard(done)
    return links


def _keyed(rows: DataFrame, percent: int):
    """Lines with a word (_rid, _id, line, key, check), from a table written once,
    which comes too; each different line's first place and how often it stands;
    the tokens that have a rank; and about how many prefix rows there are."""
    all_rows = materialize(_key_rows(rows, percent))
    lines = all_rows.where(F.col("key").isNotNull()).select("_rid", "_id", "line", "key", "check")
    often = all_rows.where(F.col("token") >= 0).groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(RANKED_TOKENS).collect()
    ranked = rows.sparkSession.sparkContext.broadcast([r["token"] for r in often])  # RANKED_TOKENS numbers
    expected = all_rows.where(F.col("token") == -1).agg(F.sum("n")).first()[0] or 0
    first = materialize(lines.groupBy("key", "check").agg(F.min(row_order("line")).alias("ord"), F.count("*").alias("n")))
    return all_rows, lines, first, ranked, expected


def _fates(lines: DataFrame, fate: DataFrame, total: int) -> DataFrame:
    """``lines`` with the columns of ``fate`` by key and check. Lines that stand
    in more than one place of HOT_SHARE are joined where they are."""
    hot = fate.where(F.col("n") * HOT_SHARE > total)  # HOT_SHARE rows at most
    rest = lines.join(F.broadcast(hot.select("key", "check")), ["key", "check"], "left_anti")
    return lines.join(F.broadcast(hot), ["key", "check"]).unionByName(rest.join(fate.where(F.col("n") * HOT_SHARE <= total), ["key", "check"]))


def _repeated(rows: DataFrame, percent: int) -> DataFrame:
    """Per row of ``rows`` (_rid, _id, _text) with lines to remove: _rid, _id, lines."""
    all_rows, lines, first, ranked, expected = _keyed(rows, percent)
    near = _near_keys(rows, "_text", first.select("key", "ord"), ranked, expected, percent)
    fate = first.join(near.withColumn("near", F.lit(True)).hint("merge"), "key", "left")
    total = first.agg(F.sum("n")).first()[0] or 0
    gone = _fates(lines, fate.where(F.col("near") | (F.col("n") > 1)), total).where((row_order("line") > F.col("ord")) | F.coalesce("near", F.lit(False)))
    found = materialize(gone.groupBy("_rid").agg(F.first("_id").alias("_id"), F.collect_set("line").alias("lines")))
    for done in (all_rows, first, near):
        discard(done)
    return found


def _print_links(lines: DataFrame, prints: DataFrame, most: int) -> DataFrame:
    """Links a, b between keys of texts whose fingerprints differ in few bits."""
    of = materialize(lines.select("_rid", "key").join(prints, "_rid").select("key", "fingerprint").distinct())
    least = materialize(of.groupBy("fingerprint").agg(F.min("key").alias("k")))
    same = of.join(least, "fingerprint").select(F.col("key").alias("a"), F.col("k").alias("b")).where("a != b")
    end = lambda c: least.select(F.col("fingerprint").alias(c), F.col("k").alias("key_" + c))
    near = close_links(least.select("fingerprint"), most=most).join(end("a"), "a").join(end("b"), "b")
    return same.unionByName(near.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")))


def near_copies(rows: DataFrame, percent: int = PERCENT, prints: DataFrame | None = None, most: int = MOST_BITS) -> DataFrame:
    """_rid of the rows of ``rows`` (_rid, _id, _text) that aren't the first of
    their component, in the order of ids and then of row numbers.

    Texts whose shingle sets have a Jaccard similarity of at least the threshold
    are linked, as are texts without a word; a text is one line here, wherever
    it is broken. No similar pair is missed. With ``prints`` (_rid, fingerprint)
    texts whose fingerprints differ in ``most`` bits at most are linked too.
    """
    flat = rows.withColumn("_text", F.replace("_text", F.lit("\n"), F.lit(" ")))
    all_rows, lines, first, ranked, expected = _keyed(flat, percent)
    links = _near_links(flat, "_text", first.select("key", "ord"), ranked, expected, percent)
    if prints is not None:
        links = links.unionByName(_print_links(lines, prints, most))
    roots = connected_components(links)
    rooted = first.join(roots.withColumnRenamed("v", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = rooted.groupBy("root").agg(F.min("ord").alias("least"))
    fate = rooted.join(least, "root").select("key", "check", "n", "least")
    total = first.agg(F.sum("n")).first()[0] or 0
    copies = _fates(lines, fate, total).where(row_order("line") > F.col("least")).select("_rid")
    empty = rows.where(~F.coalesce(F.col("_text").rlike(WORD), F.lit(False))).select(row_order().alias("ord"))
    kept = empty.agg(F.min("ord").alias("least"))  # one row
    found = materialize(copies.unionByName(empty.crossJoin(F.broadcast(kept)).where("ord > least").select("ord.rid").withColumnRenamed("rid", "_rid")))
    for done in (all_rows, first):
        discard(done)
    return found


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row with lines to remove its row number, id and lines: the numbers
    (from 0) of those lines, in no order."""
    return _repeated(numbered(docs, id_col).select("_rid", "_id", F.col("_row").getField(text_col).alias("_text")), percent)


def _masks(gone: DataFrame) -> DataFrame:
    """_rid, n (lines to remove) and gone: whether each line goes, up to the last that does."""

    def run(batches):
        for b in batches:
            masks = []
            for lines in b.column(1).to_pylist():
                mask = np.zeros(max(lines) + 1, bool)
                mask[lines] = True
                masks.append(mask)
            cuts = np.concatenate([[0], np.cumsum([len(m) for m in masks])])
            flat = pa.array(np.concatenate(masks)) if masks else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int(m.sum()) for m in masks], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat)], ["_rid", "n", "gone"])

    return gone.select("_rid", "lines").mapInArrow(run, "_rid long, n long, gone array<boolean>")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, counts: str | None = None) -> DataFrame:
    """``docs`` with its columns, without the lines that repeat earlier ones. With
    ``counts``, a name that no column has, a struct of n_lines and n_removed at the end.

    Lines without a word stay. A null text stays null and has no lines. Each row
    is a document of its own, in the order of ids; null ids come last. Rows that
    share an id, or have none, follow each other in the order they are read.
    An empty table gives no rows. A column n_chars follows the text. Texts are
    read in chunks cut between lines, so a long text is no different from others;
    only a line longer than a chunk is read in one.
    """
    if counts is not None and counts.lower() in [c.lower() for c in docs.columns]:
        raise ValueError(f"there is a column {counts} already")
    data = numbered(docs, id_col)
    gone = _masks(_repeated(data.select("_rid", "_id", F.col("_row").getField(text_col).alias("_text")), percent))
    joined = data.select("_row", "_rid").join(gone.hint("merge"), "_rid", "left").select("_row", "n", "gone")
    text = F.col("_row").getField(text_col)
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.coalesce(F.get("gone", i), F.lit(False)))
    cut = F.when(F.col("n") > 0, F.array_join(kept, "\n")).otherwise(text)
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    removed = F.coalesce("n", F.lit(0)).cast("long")
    rows = joined.select("_row", cut.alias("_text"), F.struct(F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), removed.alias("n_removed")).alias("_counts"))
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col("_text").alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.col("_counts.n_removed") > 0, F.length("_text").cast(docs.schema[c].dataType)).otherwise(F.col("_row").getField(c)).alias(c))
        else:
            cols.append(F.col("_row").getField(c).alias(c))
    return rows.select(*cols, *([F.col("_counts").alias(counts)] if counts else []))
