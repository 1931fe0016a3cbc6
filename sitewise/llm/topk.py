"""Operator 3: exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block by block. Global histograms
of the scores, refined round by round, locate each query's k-th highest value;
a last pass keeps what reaches it and breaks ties by the smaller id. Only counts
and the k best rows ever leave a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir, written

#: Queries of one block, which is broadcast; candidates scored at once; bins of
#: a histogram. Together they bound a task's memory.
BLOCK_QUERIES = 2048
CHUNK_ROWS = 2048
BINS = 512
#: Products up to this size are exact in double precision.
_EXACT = float(2**53)
#: Scores count as at most this large, either way; histograms need the room.
_LIMIT = 2**61


def _quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: float, is_query: Column) -> DataFrame:
    """asks, id, uid, whole (array of floor(scale * x)) and squares of each vector that takes part."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: _floor(x * F.lit(float(scale))))
    rows = vectors.where(ok).select(F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(id_col).cast("long").alias("id"), whole.alias("whole"))
    return rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("squares", F.aggregate("whole", F.lit(0.0), lambda a, x: a + x * x))


def _floor(x: Column) -> Column:
    """floor as a double; a double this large is whole already."""
    return F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x)


class _Block:
    """A block of queries, and for each the interval its k-th score lies in."""

    def __init__(self, rows, reach: float):
        self.bins = BINS
        self.uid = np.array([r["uid"] for r in rows], np.int64)
        self.id = np.array([r["id"] for r in rows], np.int64)
        by: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            by.setdefault(len(r["whole"]), []).append(i)
        self.groups = {n: (np.array(at), np.array([rows[i]["whole"] for i in at]).reshape(len(at), n)) for n, at in by.items()}
        reached = [np.sqrt(r["squares"]) * reach * (1 + 1e-9) + 2 if np.isfinite(reach) else np.inf for r in rows]
        bound = np.array([int(x) if x < _LIMIT else _LIMIT for x in reached], np.int64)
        self.low, self.high = -bound, bound  # inclusive
        self.above = np.zeros(len(rows), np.int64)
        self.done = np.zeros(len(rows), bool)

    def width(self) -> np.ndarray:
        return np.maximum(1, -(-(self.high - self.low + 1) // self.bins))


def _scores(block: _Block, batch) -> Iterator[tuple]:
    """(queries, scores, ids, uids, own pairs) for each vector length and chunk of a batch."""
    ids, uids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    vectors = batch.column(2)
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for n, (queries, q) in block.groups.items():
        rows = np.flatnonzero(sizes == n)
        for lo in range(0, len(rows), CHUNK_ROWS):
            own = rows[lo : lo + CHUNK_ROWS]
            c = flat[starts[own][:, None] + np.arange(n)]
            if not n or np.abs(q).max() * np.abs(c).max() * n < _EXACT:
                s = (q @ c.T).astype(np.int64)
            else:  # beyond doubles: whole numbers of any size, held to the limit
                big = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
                s = np.clip(big, -_LIMIT, _LIMIT).astype(np.int64)
            yield queries, s, ids[own], uids[own], block.uid[queries][:, None] == uids[own][None, :]


def _histograms(block: _Block, k: int):
    """Each task's counts by query and bin, from the top down to its own k-th score."""

    def run(batches):
        counts = np.zeros((len(block.uid), block.bins), np.int64)
        width = block.width()
        for b in batches:
            for queries, s, _, _, self_pair in _scores(block, b):
                lo, hi, w = block.low[queries][:, None], block.high[queries][:, None], width[queries][:, None]
                inside = (s >= lo) & (s <= hi) & ~self_pair & ~block.done[queries][:, None]
                place = queries[:, None] * block.bins + (np.where(inside, s - lo, 0) // w)
                counts += np.bincount(place[inside], minlength=counts.size).reshape(counts.shape)
        top = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
        useful = (counts > 0) & (top - counts < k)
        q, at = np.nonzero(useful)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[q, at])], ["q", "bin", "n"])

    return run


def _winners(block: _Block, k: int):
    """Each task's rows above a query's k-th score, and its k smallest ids at it."""

    def run(batches):
        best = [(np.zeros(0, np.int64),) * 3 for _ in block.uid]
        for b in batches:
            for queries, s, ids, uids, self_pair in _scores(block, b):
                hit = (s >= block.low[queries][:, None]) & ~self_pair
                for r in np.flatnonzero(hit.any(1)).tolist():
                    q, at = int(queries[r]), np.flatnonzero(hit[r])
                    have = best[q]
                    found = (np.concatenate([have[0], s[r, at]]), np.concatenate([have[1], ids[at]]), np.concatenate([have[2], uids[at]]))
                    keep = np.lexsort((found[2], found[1], -found[0]))[:k]
                    best[q] = tuple(x[keep] for x in found)
        n = [len(x[0]) for x in best]
        cat = [np.concatenate([x[i] for x in best]) if best else np.zeros(0, np.int64) for i in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block.uid, n)), pa.array(np.repeat(block.id, n)), pa.array(cat[1]), pa.array(cat[2]), pa.array(cat[0])], ["query_uid", "query_id", "vec_id", "uid", "score"])

    return run


def _run_block(vectors: DataFrame, block: _Block, k: int) -> DataFrame:
    spark = vectors.sparkSession
    cand = vectors.select("id", "uid", "whole")
    while not block.done.all() and (block.high[~block.done] > block.low[~block.done]).any():
        width = block.width()
        shipped = spark.sparkContext.broadcast(block)
        part = cand.mapInArrow(lambda it: _histograms(shipped.value, k)(it), "q int, bin int, n long")
        total = part.groupBy("q", "bin").agg(F.sum("n").alias("n"))
        from_top = Window.partitionBy("q").orderBy(F.desc("bin"))
        total = total.withColumn("top", F.sum("n").over(from_top))
        # The bin in which the count from the top first reaches k, one row a query.
        asked = spark.createDataFrame([(i, int(a)) for i, a in enumerate(block.above)], "q int, above long")
        reached = total.join(F.broadcast(asked), "q").where((F.col("top") + F.col("above") >= k) & (F.col("top") - F.col("n") + F.col("above") < k))
        rows = {r["q"]: r for r in reached.select("q", "bin", "n", "top").collect()}
        shipped.unpersist()
        for i in np.flatnonzero(~block.done).tolist():
            r = rows.get(i)
            if r is None:  # fewer than k candidates: all of them win
                block.done[i] = True
                continue
            low = int(block.low[i]) + int(r["bin"]) * int(width[i])
            block.above[i] += r["top"] - r["n"]
            block.low[i], block.high[i] = low, min(low + int(width[i]) - 1, int(block.high[i]))
    shipped = spark.sparkContext.broadcast(block)
    won = cand.mapInArrow(lambda it: _winners(shipped.value, k)(it), "query_uid long, query_id long, vec_id long, uid long, score long")
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    ranked = won.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank, vec_id, score.

    Components are floor(scale * x). A query's own row is no candidate of its;
    other rows with its id are. Equal scores go to the smaller id. Rows with a
    null id, a null vector, or a null or non-finite component take no part, and
    vectors of different lengths have no score. With fewer than k candidates all
    are returned; without queries or candidates nothing is. Scores beyond
    2**61 either way count as that. Other columns play no part.
    """
    spark = vectors.sparkSession
    rows = materialize(_quantized(vectors, id_col, vector_col, scale, is_query))
    seen = rows.agg(F.max("squares").alias("most"), F.count(F.when(F.col("asks"), 1)).alias("queries")).first()
    path = f"{shared_dir(spark).rstrip('/')}/topk-{uuid.uuid4().hex}"
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    written.append((spark, path))
    if seen["queries"]:
        n_blocks = -(-seen["queries"] // BLOCK_QUERIES)
        block_of = F.pmod(F.xxhash64("uid"), F.lit(n_blocks))
        for i in range(n_blocks):  # one pass over the candidates for each block and round
            asked = rows.where(F.col("asks") & (block_of == i)).select("uid", "id", "whole", "squares").orderBy("uid").collect()
            if asked:
                _run_block(rows, _Block(asked, float(np.sqrt(seen["most"]))), k).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
