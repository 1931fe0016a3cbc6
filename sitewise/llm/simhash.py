"""Operator 5: near-duplicates by SimHash and pigeonhole blocks.

Fingerprints that differ in few bits agree in several of the blocks they are
split into. Distinct fingerprints are joined on every choice of that many
blocks, candidates are verified by their Hamming distance, and components of the
links are found by distributed label passing. A key that many fingerprints share
is dealt out in tiles of bounded size, each tile pair meeting in one task, and a
tile yields no more links than it needs to connect what it connects.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

SHINGLE_WORDS = 3
SEED = 42
MOST_BITS = 3
#: Blocks of a fingerprint; close pairs agree in at least BLOCKS - MOST_BITS.
BLOCKS = 6
#: Fingerprints of one tile of a shared key.
TILE = 1024


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64 bits: each set if it is set in over half the shingles' hashes."""
    return _fingerprints([text], words)[0]


def _fingerprints(texts: list, words: int = SHINGLE_WORDS) -> list[int]:
    digest, join = xxhash.xxh64_intdigest, b" ".join
    out = []
    for text in texts:
        w = (text or "").encode().lower().split()  # bytes: ASCII letters and blanks alone
        if not w:
            out.append(0)
            continue
        n = max(len(w) - words + 1, 1)
        hashes = np.array([digest(join(w[i : i + words]), SEED) for i in range(n)], np.uint64)
        if n <= 4096:
            ones = _ones(hashes)
        else:
            ones = sum(_ones(hashes[i : i + 4096]) for i in range(0, n, 4096))
        out.append(int((2 * ones > n).astype(np.uint64) @ _BIT))
    return out


_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(0, dtype=np.int64)


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """The id, and fingerprint as a long (the unsigned 64 bits, read as signed)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            prints = np.array(_fingerprints(b.column(1).to_pylist(), words), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], ["_id", "fingerprint"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {id_type}, fingerprint long").withColumnRenamed("_id", id_col)


def block_masks(blocks: int = BLOCKS, most: int = MOST_BITS) -> list[int]:
    """Masks of every choice of blocks - most blocks of the 64 bits."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(block, blocks - most)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(members: list[int], most: int) -> list[tuple[int, int]]:
    """Links between fingerprints within ``most`` bits, enough to connect what they connect."""
    f = np.unique(np.array(members, np.int64)).view(np.uint64)
    left = np.ones(len(f), bool)
    links = []
    for s in range(len(f)):
        if not left[s]:
            continue
        left[s] = False
        stack = [s]
        while stack:
            i = stack.pop()
            near = np.flatnonzero(left & (np.bitwise_count(f ^ f[i]) <= most))
            left[near] = False
            links.extend((i, j) for j in near.tolist())
            stack.extend(near.tolist())
    signed = f.view(np.int64)
    return [(int(signed[i]), int(signed[j])) for i, j in links]


def close_links(prints: DataFrame, col: str = "fingerprint", most: int = MOST_BITS, blocks: int = BLOCKS) -> DataFrame:
    """Links a, b between distinct fingerprints, whose components are those of
    all pairs that differ in at most ``most`` bits. Every link is such a pair.
    """
    masks = block_masks(blocks, most)
    keyed = prints.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(col).bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])).alias("x"), F.col(col).alias("f")).select("x.c", "x.k", "f")
    shared = keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    held = keyed.join(shared, ["c", "k"])
    # s parts of a key; the rows of part p are in the tiles (p, q) of all q.
    s = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    parted = held.withColumn("s", s).withColumn("p", F.pmod(F.xxhash64("f"), F.col("s")).cast("int"))
    tiled = parted.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    tiles = tiled.groupBy("c", "k", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")).agg(F.collect_list("f").alias("fs"))

    def link(batches):
        for b in batches:
            found = [x for fs in b.column(0).to_pylist() for x in _forest(fs, most)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return tiles.select("fs").mapInArrow(link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, most: int = MOST_BITS) -> DataFrame:
    """The id, fingerprint (long) and component_id of every row.

    component_id is the smallest id reachable over links of at most ``most``
    differing bits, the row's own included. Null and empty texts, and texts of
    blanks, have fingerprint 0 and are linked like any other. Rows with a null
    id get a row too, and the component of their fingerprint; it is null if no
    row of the component has an id. An empty table gives no rows; other columns
    play no part.
    """
    prints = materialize(simhash_fingerprints(docs, id_col, text_col, words))
    distinct = materialize(prints.groupBy("fingerprint").agg(F.min(id_col).alias("least")))
    roots = connected_components(close_links(distinct.select("fingerprint"), most=most))
    rooted = distinct.join(roots.withColumnRenamed("v", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.join(least, "root").select("fingerprint", "component_id")
    return prints.join(of_print, "fingerprint").select(id_col, "fingerprint", "component_id")


def hex_digits(col: str = "fingerprint") -> Column:
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))
