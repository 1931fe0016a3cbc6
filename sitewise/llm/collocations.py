"""Operator 12: phrase collocations by truncated suffixes.

Every word starts a suffix of up to max_n words, cut at the end of its piece.
Suffixes are shuffled by language and first word; a task sorts its own in
reverse lexicographic order, so that the suffixes that share a prefix follow
each other, and counts all prefixes in one pass: the stack of open prefixes is
cut back to what a suffix shares with the one before. Parts of phrases are
joined to their counts afterwards.

A phrase is no more frequent than its words, so a word below the least count
ends a suffix like the end of a piece. Equal suffixes are added up where they
are read. A first word that starts too many suffixes for a task is split by the
words that follow; prefixes shorter than the split are added up from the parts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, hashed_sample, materialize
from .line_dedup import _key_filter

MAX_WORDS = 5
LEAST_COUNT = 100
TOP = 2000
SEED = 42
#: Words written in two bytes; others follow as 64-bit hashes.
SHORT_CODES = 0xFFFE
#: Bytes of text split at once, words held before suffixes are sorted and sent,
#: words whose number a worker remembers.
CHUNK_BYTES = 1 << 20
WORDS_AT_ONCE = 1 << 20
REMEMBERED = 1 << 20
#: Suffixes of a range, on average, and of a single prefix in one range.
RANGE_ROWS = 100_000
#: Rows a task holds of one range before it hands on what it has counted.
RANGE_MOST = 2_000_000
#: Prefixes of each length that are split further, at most, and the documents and
#: their characters that tell which: they decide where suffixes are counted, never what.
SPLIT_PREFIXES = 1 << 14
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 20_000
FILTER_BITS = 1 << 20, 1 << 30

_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _tokens(texts: list[bytes]):
    """Words of lower-cased texts in lists, with a line end for each end of a piece
    and empty words between blanks."""
    raw, at = b"\n".join(texts).lower().translate(_BREAKS) + b"\n", 0
    while at < len(raw):
        end = len(raw)
        if end - at > CHUNK_BYTES:
            cut = max(raw.rfind(b" ", at, at + CHUNK_BYTES), raw.rfind(b"\n", at, at + CHUNK_BYTES))
            if cut < 0:  # a word longer than a chunk
                cut = min(x for x in (raw.find(b" ", at), raw.find(b"\n", at)) if x >= 0)
            end = cut + 1
        yield raw[at:end].replace(b"\n", b" \n ").split(b" ")
        at = end


def _by_lang(batch) -> dict[str, list[bytes]]:
    out: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        out.setdefault(lang, []).append(text)
    return out


def _word_counts(docs: DataFrame) -> DataFrame:
    """lang, word and n: how often a word stands in a language's texts."""

    def rows(lang, counts):
        counts.pop(b"", None)
        counts.pop(b"\n", None)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    def run(batches):
        for b in batches:
            for lang, texts in _by_lang(b).items():
                counts: Counter = Counter()
                for tokens in _tokens(texts):
                    counts.update(tokens)
                    if len(counts) > REMEMBERED:
                        yield rows(lang, counts)
                        counts = Counter()
                yield rows(lang, counts)

    return docs.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class _Numbers(dict):
    """Numbers of words: 0 for one that is too rare and for the end of a piece, -1
    for none. codes holds a word's short code, or its hash with the top bit set."""

    def __init__(self, maybe: bytes, short: dict[int, int]):
        self.bits, self.size, self.short = maybe, 8 * len(maybe), short
        self.codes = [0]
        self[b""], self[b"\n"] = -1, 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, SEED)
        code = self.short.get(h) or (h | 1 << 63 if self._frequent(h) else 0)
        self[word] = number = len(self.codes) if code else 0
        if code:
            self.codes.append(code)
        return number

    def _frequent(self, h: int) -> bool:
        for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
            at = (((h * odd) & 0xFFFFFFFFFFFFFFFF) >> 30) % self.size
            if not self.bits[at >> 3] >> (at & 7) & 1:
                return False
        return True


def _suffixes(numbers: np.ndarray, max_n: int) -> np.ndarray:
    """Suffixes of two words and more, a row each, 0 from their end on, of all
    places but the last max_n - 1."""
    m = len(numbers) - max_n + 1
    cols = [numbers[:m]]
    for k in range(1, max_n):
        cols.append(np.where(cols[-1] != 0, numbers[k : m + k], 0))
    some = np.flatnonzero((cols[0] != 0) & (cols[1] != 0))
    return np.stack([c[some] for c in cols], 1)


def _sorted(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows in reverse lexicographic order, and their counts."""
    width = max(1, int(rows.max(initial=0)).bit_length())
    per = 63 // width
    keys = []
    for lo in range(0, rows.shape[1], per):
        key = np.zeros(len(rows), np.int64)
        for c in range(lo, min(lo + per, rows.shape[1])):
            key = (key << width) | rows[:, c]
        keys.append(key)
    order = np.lexsort(keys[::-1])[::-1] if len(keys) > 1 else np.argsort(keys[0])[::-1]
    rows = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    start = np.flatnonzero(new)
    return rows[start], np.add.reduceat(n[order], start) if len(start) else n[:0]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _places(lang: str, codes: np.ndarray, split: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each suffix's language and first words, and of how many words:
    one, or one more than its longest prefix that is to be split."""
    h = _mixed(codes[:, 0] * _ODD + np.uint64(xxhash.xxh64_intdigest(lang.encode(), SEED)))
    depth = np.ones(len(codes), np.uint8)
    some = np.arange(len(codes))
    for d, hot in enumerate(split, 1):
        some = some[np.isin(h[some], hot)]
        h[some] = _mixed(h[some] * _ODD + codes[some, d])
        depth[some] = d + 1
    return h, depth


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes first: zeros then lie together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _packed(codes: np.ndarray, depth: np.ndarray, n: np.ndarray) -> bytes:
    """Suffixes as a blob: short codes column by column, then what they escape to."""
    long = codes >> np.uint64(63) != 0
    short = np.where(long, np.uint64(SHORT_CODES + 1), codes).astype("<u2")
    return np.array([len(codes)], "<i8").tobytes() + b"".join(_planes(np.ascontiguousarray(c)) for c in short.T) + depth.tobytes() + _planes(n.astype("<i8")) + codes.T[long.T].astype("<u8").tobytes()


def _unpacked(blob: bytes, max_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = int(np.frombuffer(blob, "<i8", 1)[0])
    at, codes = 8, np.zeros((max_n, m), np.uint64)
    for c in range(max_n):
        codes[c] = np.ascontiguousarray(np.frombuffer(blob, np.uint8, 2 * m, at).reshape(2, m).T).reshape(-1).view("<u2")
        at += 2 * m
    depth = np.frombuffer(blob, np.uint8, m, at)
    n = np.ascontiguousarray(np.frombuffer(blob, np.uint8, 8 * m, at + m).reshape(8, m).T).reshape(-1).view("<i8")
    codes[codes == SHORT_CODES + 1] = np.frombuffer(blob, "<u8", -1, at + 9 * m)
    return codes.T, depth, n


def _suffix_blobs(docs: DataFrame, shipped, max_n: int, ranges: int) -> DataFrame:
    """The suffixes of all texts as blobs, one for each range and language of a batch."""

    def blobs(numbers, lang, a):
        rows = _suffixes(a, max_n)
        rows, n = _sorted(rows, np.ones(len(rows), np.int64))
        codes = np.array(numbers.codes, np.uint64)[rows]
        h, depth = _places(lang, codes, shipped.value["split"])
        r = ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        order = np.argsort(r, kind="stable")
        r = r[order]
        cuts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
        found = [_packed(codes[o], depth[o], n[o]) for o in np.split(order, cuts[1:])] if len(r) else []
        return pa.RecordBatch.from_arrays([pa.array(r[cuts].astype(np.int64)), pa.array([lang] * len(found), pa.string()), pa.array(found, pa.binary())], ["r", "lang", "blob"])

    def run(batches):
        fresh = lambda: _Numbers(shipped.value["maybe"], shipped.value["short"])
        numbers, held, size = fresh(), {}, 0
        for b in batches:
            for lang, texts in _by_lang(b).items():
                for tokens in _tokens(texts):
                    a = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
                    held.setdefault(lang, []).append(a[a >= 0])
                    size += len(held[lang][-1])
                    if size < WORDS_AT_ONCE and len(numbers) <= REMEMBERED:
                        continue
                    ends = {}
                    for own, parts in held.items():  # the last words may go on in the next chunk
                        a = np.concatenate(parts)
                        yield blobs(numbers, own, a)
                        ends[own] = a[-(max_n - 1) :]
                    size = sum(map(len, ends.values()))
                    if len(numbers) > REMEMBERED:
                        codes, numbers = np.array(numbers.codes, np.uint64), fresh()
                        for own, a in ends.items():
                            ends[own] = np.where(a != 0, np.arange(len(a)) + len(numbers.codes), 0)
                            numbers.codes.extend(codes[a].tolist())
                    held = {own: [a] for own, a in ends.items()}
        for own, parts in held.items():
            yield blobs(numbers, own, np.concatenate([*parts, np.zeros(max_n - 1, np.int64)]))

    return docs.mapInArrow(run, "r long, lang string, blob binary")


def _prefix_rows(lang: str, codes, depth, n, words: np.ndarray, least: int, partial: bool):
    """Prefixes of two words and more of some suffixes, with their counts: those
    that reach ``least``, and all that other suffixes elsewhere add to."""
    known, rows = np.unique(codes, return_inverse=True)
    rows = rows.reshape(codes.shape)
    if known[:1].tolist() != [0]:  # number 0 is the end of a suffix
        known, rows = np.concatenate([np.zeros(1, np.uint64), known]), rows + 1
    # The depth follows from the suffix, so it sorts with it.
    both, n = _sorted(np.column_stack([rows, depth]), n)
    rows, depth = both[:, :-1], both[:, -1]
    shared = np.zeros(len(rows), np.int64)  # words in common with the suffix before: what stays on the stack
    same = np.ones(max(len(rows) - 1, 0), bool)
    for c in range(rows.shape[1]):
        same &= rows[1:, c] == rows[:-1, c]
        shared[1:] += same
    long = known >> np.uint64(63) != 0
    hashes = np.where(long, known, words[np.where(long, 0, known).astype(np.int64)])
    for k in range(2, rows.shape[1] + 1):
        start = np.flatnonzero(shared < k)
        if not len(start):
            continue
        total, first = np.add.reduceat(n, start), rows[start, :k]
        use = (first[:, -1] != 0) & (partial | (depth[start] > k) | (total >= least))
        keys = np.ascontiguousarray(hashes[first[use]].astype(">u8"))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array([x.tobytes() for x in keys], pa.binary()), pa.array(total[use])], ["lang", "key", "n"])


def _phrase_counts(blobs: DataFrame, shipped, max_n: int, least: int) -> DataFrame:
    """lang, key (the words' hashes) and n of every phrase of two words and more.

    A task holds one range of a language at a time. If its different suffixes
    come to more than RANGE_MOST, their prefixes are handed on as parts.
    """

    def merged(held):
        codes, depth, n = (np.concatenate(x) for x in zip(*held))
        known, rows = np.unique(codes, return_inverse=True)
        both, n = _sorted(np.column_stack([rows.reshape(codes.shape), depth]), n)
        return [(known[both[:, :-1]], both[:, -1].astype(np.uint8), n)]

    def run(batches):
        words = shipped.value["words"]
        now, held, size, partial = None, [], 0, False
        for b in batches:
            for r, lang, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if (r, lang) != now:
                    if held:
                        yield from _prefix_rows(now[1], *merged(held)[0], words, least, partial)
                    now, held, size, partial = (r, lang), [], 0, False
                held.append(_unpacked(blob.as_py(), max_n))
                size += len(held[-1][2])
                if size > RANGE_MOST:
                    held = merged(held)
                    size = len(held[0][2])
                    if 2 * size > RANGE_MOST:
                        partial = True
                        yield from _prefix_rows(lang, *held[0], words, least, partial)
                        held, size = [], 0
        if held:
            yield from _prefix_rows(now[1], *merged(held)[0], words, least, partial)

    dealt = blobs.repartition("r", "lang").sortWithinPartitions("r", "lang")
    return dealt.mapInArrow(run, "lang string, key binary, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _split_prefixes(docs: DataFrame, shipped: dict, max_n: int, total: int) -> list[np.ndarray]:
    """By length, the prefixes that start more than RANGE_ROWS suffixes by a sample."""
    sample = hashed_sample(docs.select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text")), "text", SAMPLE_DOCS)
    numbers, parts, seen = _Numbers(shipped["maybe"], shipped["short"]), [], 0
    by: dict[str, list] = {}
    for r in sample.toLocalIterator():
        by.setdefault(r["lang"], []).append(bytes(r["text"]))
    for lang, texts in by.items():
        a = np.concatenate([np.array([x for x in map(numbers.__getitem__, t) if x >= 0], np.int64) for t in _tokens(texts)])
        seen += len(a)
        parts.append((lang, _suffixes(np.concatenate([a, np.zeros(max_n - 1, np.int64)]), max_n)))
    found: list[np.ndarray] = []
    for _ in range(max_n - 1):
        hashes = [_places(lang, np.array(numbers.codes, np.uint64)[rows], found) for lang, rows in parts]
        deep = np.concatenate([h[d == len(found) + 1] for h, d in hashes] or [np.zeros(0, np.uint64)])
        prefix, n = np.unique(deep, return_counts=True)
        # Twice at least, so that a single long document does not count.
        hot = (n >= 2) & (n * (total / max(seen, 1)) > RANGE_ROWS)
        order = np.argsort(-n[hot], kind="stable")[:SPLIT_PREFIXES]
        found.append(np.sort(prefix[hot][order]))
    return found


def _key_of(h: Column) -> Column:
    return F.unhex(F.lpad(F.hex(h), 16, "0"))


def collocations(docs: DataFrame, max_n: int = MAX_WORDS, least: int = LEAST_COUNT, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Texts are cut into pieces at . , ; : ! ? and line ends, pieces into words at
    blanks and tabs, letters A-Z lower-cased. A phrase of 2 to ``max_n`` words
    with a count a of at least ``least`` is cut after each word: l and r are the
    counts of its parts, n that of all words of the language, and its score is
    the lowest floor(1000 * a * n / (l * r)), of the first cut with it. A phrase
    that stands inside a longer one as often is left out. Equal scores are
    ordered by a, falling, then by the phrase's bytes.

    A null lang is "und"; null and empty texts and pieces have no words; repeated
    rows count again. An empty table gives no rows; other columns play no part. A
    long text is read in chunks, phrases across their ends included. Words are
    told apart by 64 bits of hash.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    counted = materialize(_word_counts(texts).withColumn("h", F.xxhash64("word")))
    sizes = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    often = counted.where(F.col("n") >= least)
    of_hash = often.groupBy("h").agg(F.sum("n").alias("n"))
    stats = of_hash.agg(F.count("*").alias("words"), F.sum("n").alias("n")).first()
    short = [r["h"] & 0xFFFFFFFFFFFFFFFF for r in of_hash.orderBy(F.desc("n"), "h").limit(SHORT_CODES).collect()]
    bits = min(max(1 << (16 * stats["words"]).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    known = {"maybe": _key_filter(of_hash.select("h"), bits), "short": {h: i + 1 for i, h in enumerate(short)}, "words": np.array([0, *(h | 1 << 63 for h in short)], np.uint64)}
    known["split"] = _split_prefixes(texts, known, max_n, stats["n"] or 0)
    shipped = spark.sparkContext.broadcast(known)
    ranges = min(max(64, (stats["n"] or 0) // RANGE_ROWS), 1 << 31)
    phrases = materialize(_phrase_counts(_suffix_blobs(texts, shipped, max_n, ranges), shipped, max_n, least))
    words = often.select("lang", _key_of(F.col("h").bitwiseOR(F.lit(-(1 << 63)))).alias("key"), F.col("word").cast("string").alias("word"), "n")
    counts = phrases.unionByName(words.select("lang", "key", "n"))

    size = (F.octet_length("key") / 8).cast("int")
    cut = phrases.select("lang", "key", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    parts = cut.select("*", F.expr("substring(key, 1, 8 * k)").alias("left"), F.expr("substring(key, 8 * k + 1)").alias("right"))
    parts = parts.join(counts.select("lang", F.col("key").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    parts = parts.join(counts.select("lang", F.col("key").alias("right"), F.col("n").alias("r")), ["lang", "right"]).join(sizes, "lang")
    whole = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r", "total")}
    parts = parts.select("lang", "key", "a", "l", "r", "k", "total", (F.lit(1000).cast("decimal(4,0)") * (whole["a"] * whole["total"])).alias("x"), (whole["l"] * whole["r"]).alias("y"))
    scored = parts.withColumn("score", F.expr("x div y"))
    scored = scored.groupBy("lang", "key", "a").agg(F.min(F.struct("score", "k", "l", "r", "total")).alias("best")).select("lang", "key", "a", "best.*")

    longer = phrases.where(F.octet_length("key") > 16)
    ends = F.array(F.expr("substring(key, 1, length(key) - 8)"), F.expr("substring(key, 9)"))
    inside = longer.select("lang", F.explode(ends).alias("key"), "n").groupBy("lang", "key").agg(F.max("n").alias("most"))
    left = scored.join(inside, ["lang", "key"], "left").where(F.col("most").isNull() | (F.col("most") < F.col("a"))).drop("most")
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = materialize(left.withColumn("place", F.rank().over(first)).where(F.col("place") <= top))

    spelt = near.select("lang", "key", F.posexplode(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.col("key").substr(8 * i + 1, F.lit(8)))).alias("i", "w"))
    spelt = spelt.join(words.select("lang", F.col("key").alias("w"), "word"), ["lang", "w"]).groupBy("lang", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = near.join(spelt, ["lang", "key"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = materialize(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"))
    for done in (counted, phrases, near):
        discard(done)
    return out
