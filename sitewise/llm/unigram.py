"""Operator 10: SentencePiece encoding and decoding.

The best segmentation under a unigram model is found by Viterbi over a
double-array trie of the pieces with their log scores. Characters no piece
covers fall back to byte pieces. The trie is built once on the driver, its size
is that of the vocabulary, and workers share it by broadcast.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of

SPACE = "▁"
#: How much worse than the worst piece an uncovered character scores.
UNKNOWN_PENALTY = 10.0
CACHE_ENTRIES = 200_000
CACHED_CHARS = 64
#: Characters of texts whose new words are learned at once, and words that go
#: through one Viterbi side by side.
CHARS_AT_ONCE = 2_000_000
WORDS_AT_ONCE = 8192
ROWS_AT_ONCE = 1024


class DoubleArrayTrie:
    """Byte trie in two integer arrays; ``value`` holds the id of a full key or -1.

    The child of node s by byte c is base[s] + c + 1 if check there is s.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        keys, values = [keys[i] for i in order], [values[i] for i in order]
        size = 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        start_at = 1
        stack = [(0, 0, len(keys), 0)]
        while stack:
            node, lo, hi, depth = stack.pop()
            while lo < hi and len(keys[lo]) == depth:
                value[node] = values[lo]
                lo += 1
            children = []
            while lo < hi:
                c, end = keys[lo][depth], lo
                while end < hi and keys[end][depth] == c:
                    end += 1
                children.append((c, lo, end))
                lo = end
            if not children:
                continue
            first = children[0][0] + 1
            while start_at < size and check[start_at] != -1:
                start_at += 1
            at, tries = max(start_at, first), 0
            while True:
                b = at - first
                top = b + children[-1][0] + 1
                if top >= size:
                    grow = max(size, top + 1 - size)
                    base += [0] * grow
                    check += [-1] * grow
                    value += [-1] * grow
                    size += grow
                if all(check[b + c + 1] == -1 for c, _, _ in children):
                    break
                at += 1
                tries += 1
            if tries > 2000:  # the crowded front is not worth another search
                start_at = max(start_at, at - 1000)
            base[node] = b
            for c, l, r in children:
                check[b + c + 1] = node
                stack.append((b + c + 1, l, r, depth + 1))
        used = max(i for i, c in enumerate(check) if c != -1) + 1 + 256
        fit = lambda x, fill: np.array((x + [fill] * used)[:used], np.int32)
        self.base, self.check, self.value = fit(base, 0), fit(check, -1), fit(value, -1)


class UnigramModel:
    """Pieces, scores and flags of a SentencePiece file, ready to ship."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, kind = spec.normalizer_spec, pb.ModelProto.SentencePiece
        if norm.precompiled_charsmap:
            raise ValueError("only files with the identity normaliser are supported")
        self.dummy_prefix, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.pieces = [p.piece for p in spec.pieces]
        self.kinds = [p.type for p in spec.pieces]
        self.unknown = self.kinds.index(kind.UNKNOWN)
        self.bytes_at = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == kind.BYTE}
        plain = [i for i, k in enumerate(self.kinds) if k in (kind.NORMAL, kind.USER_DEFINED) and self.pieces[i]]
        normal = [spec.pieces[i].score for i in plain if self.kinds[i] == kind.NORMAL]
        lowest, highest = min(normal, default=0.0), max(normal, default=0.0)
        self.scores = [float(p.score) for p in spec.pieces]
        for i in plain:
            if self.kinds[i] == kind.USER_DEFINED:
                self.scores[i] = len(self.pieces[i]) * highest - 0.1
        self.unknown_score = lowest - UNKNOWN_PENALTY
        #: True if no piece has the marker after another character, so that
        #: the best path of a text is that of its words one by one.
        self.by_word = all(SPACE not in self.pieces[i].lstrip(SPACE) for i in plain)
        self.trie = DoubleArrayTrie([self.pieces[i].encode() for i in plain], plain)
        control = {kind.CONTROL, kind.UNKNOWN}
        byte_of = {i: bytes([b]) for b, i in self.bytes_at.items()}
        self.decoded = [b"" if k == kind.CONTROL else " ⁇ ".encode() if k in control else byte_of.get(i, p.encode()) for i, (p, k) in enumerate(zip(self.pieces, self.kinds))]


class UnigramCodec:
    """Encoding and decoding on a worker, with a bounded cache."""

    def __init__(self, model: UnigramModel):
        self.model = model
        t = model.trie
        self._base, self._check, self._value = t.base.tolist(), t.check.tolist(), t.value.tolist()
        self._words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall if model.by_word else lambda text: [text] if text else []
        self._known: dict[str, bytes] = {}
        self._scores = np.array(model.scores)
        self._byte_ids = np.array([model.bytes_at[b] for b in range(256)] if model.bytes_at else [model.unknown])
        #: Bytes of the character that a byte begins.
        self._width = np.repeat([1, 2, 3, 4], [0xC0, 0x20, 0x10, 0x10])

    def normalized(self, text: str) -> str:
        m = self.model
        if m.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if text and m.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE)

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path; of equal paths to a place the first found stays.

        Paths are found by rising start, then rising end.
        """
        m, base, check, value, scores = self.model, self._base, self._check, self._value, self.model.scores
        raw = text.encode()
        n = len(raw)
        best, back, by = [None] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        limit, start = len(check), 0
        while start < n:
            lead = raw[start]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, node, single = best[start], 0, False
            for end in range(start, n):
                to = base[node] + raw[end] + 1
                if to >= limit or check[to] != node or to == 0:
                    break
                node = to
                piece = value[node]
                if piece >= 0:
                    score, at = here + scores[piece], end + 1
                    if best[at] is None or score > best[at]:
                        best[at], back[at], by[at] = score, start, piece
                    single = single or at - start == width
            if not single:
                score, at = here + m.unknown_score, start + width
                if best[at] is None or score > best[at]:
                    best[at], back[at], by[at] = score, start, -1
            start += width
        out, at = [], n
        while at > 0:
            start = back[at]
            if by[at] >= 0:
                out.append(by[at])
            elif m.bytes_at:
                out.extend(m.bytes_at[b] for b in reversed(raw[start:at]))
            else:
                out.append(m.unknown)
            at = start
        return out[::-1]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit.

        Every different word is encoded once, CHARS_AT_ONCE characters of texts
        at a time, and remembered as long as the worker's memory of words lasts.
        """
        out = []
        for lo, hi in batches_of([len(t) for t in texts], CHARS_AT_ONCE):
            parts = [self._words(self.normalized(t)) for t in texts[lo:hi]]
            words = set().union(*parts)
            new = sorted(words.difference(self._known), key=len)
            short = [w for w in new if len(w) <= CACHED_CHARS]
            for at in range(0, len(short), WORDS_AT_ONCE):
                some = short[at : at + WORDS_AT_ONCE]
                self._known.update(zip(some, self._side_by_side(some)))
            for word in new[len(short) :]:
                self._known[word] = np.array(self.viterbi(word), "<u4").tobytes()
            ids = self._known.__getitem__
            out += [b"".join(map(ids, p)) for p in parts]
            for word in new[len(short) :]:
                del self._known[word]
            if len(self._known) > CACHE_ENTRIES:
                self._known = {w: self._known[w] for w in words if w in self._known}
        return out

    def _side_by_side(self, words: list[str]) -> list[bytes]:
        """``viterbi`` of many words at once, as bytes."""
        t, m, scores = self.model.trie, self.model, self._scores
        raw = [w.encode() for w in words]
        size = np.array([len(x) for x in raw])
        n, most = len(raw), int(size.max(initial=0))
        text = np.zeros((n, most), np.int64)
        text[np.arange(most) < size[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
        best = np.full((n, most + 1), -np.inf)
        best[:, 0] = 0.0
        back, by = np.zeros((n, most + 1), np.int32), np.full((n, most + 1), -1, np.int32)
        for start in range(most):
            on = np.flatnonzero((size > start) & (best[:, start] > -np.inf))
            here, ends = best[on, start], start + self._width[text[on, start]]
            single = np.zeros(n, bool)
            row, node, score0 = on, np.zeros(len(on), np.int64), here
            for end in range(start, most):
                to = t.base[node] + text[row, end] + 1
                to = np.where(to < len(t.check), to, 0)
                go = (t.check[to] == node) & (to != 0) & (size[row] > end)
                row, node, score0 = row[go], to[go], score0[go]
                if not len(row):
                    break
                piece = t.value[node]
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    at, r, p = end + 1, row[hit], piece[hit]
                    score = score0[hit] + scores[p]
                    more = score > best[r, at]
                    r = r[more]
                    best[r, at], back[r, at], by[r, at] = score[more], start, p[more]
                    single[row[hit]] |= end + 1 - start == self._width[text[row[hit], start]]
            bare = ~single[on]
            r, at = on[bare], ends[bare]
            score = here[bare] + m.unknown_score
            more = score > best[r, at]
            r, at = r[more], at[more]
            best[r, at], back[r, at], by[r, at] = score[more], start, -1
        found, at, row = [], size.copy(), np.arange(n)
        while len(row):
            end = at[row]
            at[row] = back[row, end]
            found.append((row, by[row, end], at[row], end))
            row = row[at[row] > 0]
        rows, ids, begin, end = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(rows, kind="stable")[::-1]  # last word first, each from its first piece on
        rows, ids, begin, end = rows[order], ids[order], begin[order], end[order]
        bare = np.flatnonzero(ids < 0)
        count = np.ones(len(ids), np.int64)
        if m.bytes_at:
            count[bare] = (end - begin)[bare]  # an uncovered character is its bytes
        ids, first = np.repeat(ids, count), np.cumsum(count) - count
        for i in bare.tolist():
            c = count[i]
            ids[first[i] : first[i] + c] = self._byte_ids[text[rows[i], begin[i] : end[i]] if m.bytes_at else [0]]
        flat, cuts = ids.astype("<u4").tobytes(), np.cumsum(np.bincount(rows, count, minlength=n).astype(np.int64)[::-1])
        return [flat[4 * a : 4 * z] for a, z in zip([0, *cuts[:-1].tolist()], cuts.tolist())][::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit."""
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are not UTF-8 become U+FFFD."""
        table = self.model.decoded
        text = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf8", "replace").replace(SPACE, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, and ids as array<int>.

    A null or empty text gives an empty array. Null and repeated ids keep their
    rows; an empty table gives no rows; other columns play no part. A text of any
    length is encoded whole: word by word, or at one go where it is one word.
    """
    def many(codec, texts):
        return [(np.frombuffer(x, "<u4").astype(np.int32).tolist(),) for x in codec.encode_all([t or "" for t in texts])]

    return _apply(docs, model_path, id_col, text_col, "string", "ids array<int>", many, [pa.list_(pa.int32())])


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Inverse of ``encode_pieces``: the id and text. Null ids give an empty text.

    Null or out-of-range ids inside an array are unknown pieces.
    """

    def one(codec, ids):
        n = len(codec.model.pieces)
        clean = [i if i is not None and 0 <= i < n else codec.model.unknown for i in ids] if ids is not None else []
        return (codec.decode(np.array(clean, "<u4").tobytes()),)

    def many(codec, values):
        return [one(codec, ids) for ids in values]

    return _apply(encoded, model_path, id_col, ids_col, "array<int>", "text string", many, [pa.string()])


def encoding_digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_pieces, n_byte_pieces, ids_crc32 and round_trip of every row.

    round_trip is true if decoding gives the text back, the marker character
    read as the blank it stands for. Null texts count as empty.
    """
    def many(codec, texts):
        as_bytes = codec.__dict__.setdefault("byte_pieces", np.isin(np.arange(len(codec.model.pieces)), list(codec.model.bytes_at.values())))
        texts, rows = [t or "" for t in texts], []
        for text, ids in zip(texts, codec.encode_all(texts)):
            arr = np.frombuffer(ids, "<u4")
            rows.append((len(arr), int(as_bytes[arr].sum()), zlib.crc32(ids), codec.decode(ids) == text.replace(SPACE, " ")))
        return rows

    return _apply(docs, model_path, id_col, text_col, "string", "n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean", many, [pa.int64(), pa.int64(), pa.int64(), pa.bool_()])


def _apply(df, model_path, id_col, col, col_type, schema, many, types):
    model = df.sparkSession.sparkContext.broadcast(UnigramModel(model_path))  # the vocabulary's size
    names = [x.split()[0] for x in schema.split(", ")]
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = UnigramCodec(model.value)
        for b in batches:
            rows = []
            for lo in range(0, len(b), ROWS_AT_ONCE):
                rows += many(codec, b.column(1).slice(lo, ROWS_AT_ONCE).to_pylist())
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["_id", *names])

    return df.select(F.col(id_col).alias("_id"), F.col(col).cast(col_type).alias("_x")).mapInArrow(run, f"_id {id_type}, {schema}").withColumnRenamed("_id", id_col)
