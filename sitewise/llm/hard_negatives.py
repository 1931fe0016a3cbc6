"""Operator 13: hard negatives by a norm-bucketed search.

Candidates are sorted by norm and packed into buckets. A product of vectors is
at most the product of their norms, so a bucket whose largest norm can't reach
what a window still needs is skipped for it: neither the window's lower limit
nor, once k rows are found, its k-th score. Buckets come in falling order of
norm, so within a task all later ones are skipped too.

The search runs twice. For the positives each anchor has one window without
limits, among rows of its label; for the negatives one per positive, from a
share of the positive's score up to that score, among rows of other labels.
Anchors are searched in blocks; candidates never leave their tasks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir, written
from .topk import _EXACT, _LIMIT, _floor

#: Rows and components of a bucket at most; components of a task's buckets.
BUCKET_ROWS = 1024
BUCKET_VALUES = 1 << 17
TASK_VALUES = 1 << 22
#: Anchors and components of a block at most: it is broadcast. Anchors scored at once.
BLOCK_ANCHORS = 8192
BLOCK_VALUES = 1 << 21
CHUNK_ANCHORS = 1024


def _buckets(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows of one length as buckets in falling order of norm, and each one's largest norm."""

    def pack(batches):
        for b in batches:
            size = b.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(size)]
            for lo, end in zip(cuts, cuts[1:]):
                step = max(1, min(BUCKET_ROWS, BUCKET_VALUES // max(1, int(size[lo]))))
                for a in range(lo, end, step):
                    own = b.slice(a, min(step, end - a))
                    lists = [pa.array([own.column(i).to_pylist()], pa.list_(pa.int64())) for i in range(3)]
                    flat = own.column(5).flatten()
                    values = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([*lists, pa.array([int(size[a])], pa.int32()), pa.array([np.sqrt(own.column(4).to_numpy().max())]), values], names)

    names = ["uids", "ids", "labels", "size", "top", "flat"]
    sorted_rows = rows.select("uid", "id", "label", "size", "squares", "whole").repartitionByRange(tasks, "size", F.desc("squares"), "uid").sortWithinPartitions("size", F.desc("squares"), "uid")
    return sorted_rows.mapInArrow(pack, "uids array<long>, ids array<long>, labels array<long>, size int, top double, flat array<double>")


class _Block:
    """Anchors, and the windows of each: limits (inclusive) of the scores sought."""

    def __init__(self, rows):
        self.uid, self.id, self.label = (np.array([r[c] for r in rows], np.int64) for c in ("uid", "id", "label"))
        self.norm = np.sqrt(np.array([r["squares"] for r in rows], np.float64))
        by: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            by.setdefault(len(r["whole"]), []).append(i)
        self.of_size = {n: (np.array(at), np.array([rows[i]["whole"] for i in at], np.float64).reshape(len(at), n)) for n, at in by.items()}
        self.same = True
        self.low, self.high = np.full((len(rows), 1), -_LIMIT), np.full((len(rows), 1), _LIMIT)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole inner products, held to the limit either way."""
    n = q.shape[1]
    if not n or np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * n < _EXACT:
        return (q @ c.T).astype(np.int64)
    big = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
    return np.clip(big, -_LIMIT, _LIMIT).astype(np.int64)


def _found(block: _Block, k: int):
    """Each task's k best rows of every window."""

    def run(batches):
        width = block.low.shape[1]
        best: dict[int, list] = {}
        need = block.low.copy()  # of a window: its lower limit, later its k-th score
        for b in batches:
            for i in range(b.num_rows):
                size = b.column(3)[i].as_py()
                if size not in block.of_size:
                    continue
                anchors, vectors = block.of_size[size]
                least = need[anchors].min(1)
                with np.errstate(invalid="ignore", over="ignore"):
                    reach = block.norm[anchors] * b.column(4)[i].as_py() * (1 + 1e-9) + 2
                live = np.flatnonzero(~(reach < least))
                if not len(live):
                    continue
                uids, ids, labels = (b.column(c)[i].values.to_numpy() for c in range(3))
                c = b.column(5)[i].values.to_numpy(zero_copy_only=False).reshape(len(uids), size)
                for lo in range(0, len(live), CHUNK_ANCHORS):
                    own = live[lo : lo + CHUNK_ANCHORS]
                    a = anchors[own]
                    score = _products(vectors[own], c)
                    fits = (block.label[a][:, None] == labels) == block.same
                    if block.same:
                        fits &= block.uid[a][:, None] != uids
                    for w in range(width):
                        hit = fits & (score >= need[a, w][:, None]) & (score <= block.high[a, w][:, None])
                        for r in np.flatnonzero(hit.any(1)).tolist():
                            at, q = np.flatnonzero(hit[r]), int(a[r]) * width + w
                            have = best.get(q, _NONE)
                            cols = [np.concatenate(x) for x in zip(have, (score[r, at], ids[at], uids[at]))]
                            keep = np.lexsort((cols[2], cols[1], -cols[0]))[:k]
                            best[q] = [x[keep] for x in cols]
                            if len(keep) == k:
                                need[a[r], w] = best[q][0][-1]
        n = [len(x[0]) for x in best.values()]
        score, ids, uids = (np.concatenate([x[j] for x in best.values()] or [_NONE[0]]) for j in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([*best], np.int64), n)), pa.array(score), pa.array(ids), pa.array(uids)], ["q", "score", "id", "uid"])

    return run


_NONE = [np.zeros(0, np.int64)] * 3


def _best(buckets: DataFrame, block: _Block, k: int) -> DataFrame:
    """q (anchor and window), rank, score, id of the k best rows of each window."""
    shipped = buckets.sparkSession.sparkContext.broadcast(block)
    found = buckets.mapInArrow(lambda it: _found(shipped.value, k)(it), "q long, score long, id long, uid long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low_percent: int = 80, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of floor(scale * x). An anchor's positives are the
    other rows of its label with the highest scores; for each, its negatives are
    the rows of other labels with the highest scores from ``low_percent`` of the
    positive's score (above that, so none if it is negative) up to it. Equal
    scores go to the smaller id, then to the row read first; fewer rows than
    asked for are all returned. A row is not its own positive; others with its id may be.

    Rows with a null id, label or vector, or a null or non-finite component, take
    no part, and vectors of different lengths have no score, so no pair. Repeated
    anchors are anchors each, repeated positives each have negatives. Scores
    beyond 2**61 either way count as that. Without anchors, positives or
    negatives there are no rows. Other columns play no part. Long vectors make
    smaller buckets and blocks; only one vector has to fit in memory.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    ok = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: _floor(x * F.lit(float(scale))))
    picked = vectors.where(ok).select(F.coalesce(is_anchor, F.lit(False)).alias("asks"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("whole"))
    rows = materialize(picked.withColumn("uid", F.monotonically_increasing_id()).withColumn("size", F.size("whole")).withColumn("squares", F.aggregate("whole", F.lit(0.0), lambda a, x: a + x * x)))
    seen = rows.agg(F.sum("size").alias("values"), F.count(F.when(F.col("asks"), 1)).alias("anchors"), F.max("size").alias("size")).first()
    path = f"{shared_dir(spark).rstrip('/')}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    written.append((spark, path))
    if seen["anchors"]:
        tasks = max(spark.sparkContext.defaultParallelism, -(-seen["values"] // TASK_VALUES))
        buckets = materialize(_buckets(rows, tasks))
        at_once = max(1, min(BLOCK_ANCHORS, BLOCK_VALUES // max(1, seen["size"])))
        n_blocks = -(-seen["anchors"] // at_once)
        block_of = F.pmod(F.xxhash64("uid"), F.lit(n_blocks))
        for i in range(n_blocks):
            asked = rows.where(F.col("asks") & (block_of == i)).select("uid", "id", "label", "squares", "whole").orderBy("uid").collect()  # at_once rows or so
            if asked:
                _negatives_of(buckets, _Block(asked), positives, negatives, low_percent).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _negatives_of(buckets: DataFrame, block: _Block, positives: int, negatives: int, low_percent: int) -> DataFrame:
    """The rows of one block of anchors."""
    spark = buckets.sparkSession
    of = _best(buckets, block, positives).select("q", "rank", "score", "id").collect()  # a few rows an anchor
    block.same = False
    block.low, block.high = np.full((len(block.uid), positives), _LIMIT + 1), np.full((len(block.uid), positives), -_LIMIT - 1)
    for r in of:
        block.low[r["q"], r["rank"] - 1] = -(-low_percent * r["score"] // 100)
        block.high[r["q"], r["rank"] - 1] = r["score"]
    windows = spark.createDataFrame([(r["q"] * positives + r["rank"] - 1, int(block.id[r["q"]]), r["id"], r["score"]) for r in of], "q long, anchor_id long, positive_id long, positive_score long")
    found = _best(buckets, block, negatives)
    return found.join(F.broadcast(windows), "q").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
