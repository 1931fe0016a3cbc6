"""Similarity joins and statistics of embedding vectors.

A join packs each side into blocks of near vectors and scores block against block
by matrix products. Blocks meet on a grid of strips: a block of one side goes to
each strip of the other, so it is copied about as often as the square root of
the number of tasks, however many blocks the other side has; within a task the
pairs of blocks stream. A pair of blocks whose centroids are too far apart for
any of their rows to reach the cutoff is left out (triangle inequality on the
sphere). Nothing is collected but a bounded number of pivots.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.columns import doubles, unit
from .settle import settle

#: Rows and components of a block at most.
BLOCK_ROWS = 1024
BLOCK_VALUES = 1 << 17
#: Pairs of blocks that a task scores, on average, once there are tasks enough.
TASK_PAIRS = 4096
#: Vectors that rows are sorted by, so that blocks are of near ones. They decide
#: which blocks can be left out, never what is found.
PIVOTS = 64
#: Cosines are compared after rounding to so many digits, so that the order of
#: a sum's terms does not decide.
DIGITS = 9
#: Blocks of a side that a task holds, where they meet in its memory.
STRIP_BLOCKS = 128
#: An angle's room for rounding, far above it.
SLACK = 1e-6


def unit_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds u, the vector scaled to length one."""
    return df.withColumn("u", unit(doubles(F.col(vector))))


def similarity_join(queries: DataFrame, db: DataFrame, cutoff: float | str, query_id: str, db_id: str, group: str | None = None, block_rows: int = BLOCK_ROWS, best: int | None = None, folds: int | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """Pairs with a cosine above the cutoff: query_id, db_id, cos, and the group.

    Both sides have a column u of unit vectors. ``cutoff`` is a number or a
    column of the queries. With ``group``, a column of both sides must agree.
    Rows with a null group, and vectors that are null, hold a null or differ in
    length, match nothing. With ``best``, a query keeps of each task its pairs
    of the so many highest cosines, ties by whole-numbered db_id, other ties all:
    enough for its nearest rows over all blocks, with rounded cosines; itself, or with
    ``folds`` its fold (id modulo folds), is none.
    A side that is searched again and again can be packed once (``blocks``).
    """
    cut = F.lit(float(cutoff)) if not isinstance(cutoff, str) else F.col(cutoff)
    pivots = _pivots(db, group)
    left = _blocks(queries.withColumn("_cut", cut.cast("double")), query_id, group, block_rows, pivots)
    right = packed(db, db_id, group, block_rows, pivots) if blocks is None else blocks
    if best is not None:
        return _nearest(left, right, _kind(queries, query_id), _kind(db, db_id), query_id, db_id, group, best, folds)
    return _scored(left, right, _kind(queries, query_id), _kind(db, db_id), query_id, db_id, group)


def packed(db: DataFrame, db_id: str, group: str | None = None, block_rows: int = BLOCK_ROWS, pivots: dict[int, np.ndarray] | None = None) -> DataFrame:
    """The blocks of a side that is searched, for ``similarity_join``."""
    return _blocks(db.withColumn("_cut", F.lit(0.0)), db_id, group, block_rows, _pivots(db, group) if pivots is None else pivots)


def similar_pairs(df: DataFrame, cutoff: float, id_col: str, group: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Unordered pairs a < b with a cosine above the cutoff: a, b, cos, and the group.

    Each pair of blocks is scored once. Rows with equal ids are no pair.
    """
    blocks = _blocks(df.withColumn("_cut", F.lit(float(cutoff))), id_col, group, block_rows, _pivots(df, group))
    kind = _kind(df, id_col)
    found = _scored(blocks, blocks, kind, kind, "_q", "_d", group, once=True)
    return found.select(F.least("_q", "_d").alias("a"), F.greatest("_q", "_d").alias("b"), "cos", *([group] if group else []))


def _kind(df: DataFrame, col: str):
    return df.schema[col].dataType


def _taking_part(df: DataFrame, group: str | None) -> DataFrame:
    own = df.where(F.col("u").isNotNull() & ~F.exists("u", lambda x: x.isNull()))
    return own.where(F.col(group).isNotNull()) if group else own


def near_pivots(df: DataFrame) -> dict[int, np.ndarray]:
    """What a side without groups is sorted by, for ``marked_reach`` again and again."""
    return _pivots(df, None)


def _pivots(df: DataFrame, group: str | None) -> dict[int, np.ndarray]:
    """PIVOTS vectors at most, those with the smallest hashes, by length, each near
    the one before: what is sorted by their number is sorted by place."""
    rows = _taking_part(df, group).select("u").orderBy(F.xxhash64("u")).limit(PIVOTS).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["u"]), []).append(r["u"])
    return {n: _toured(np.array(v)) for n, v in by.items()}


def _toured(u: np.ndarray) -> np.ndarray:
    """From the first vector on always the nearest that is left."""
    cos, order, left = u @ u.T, [0], set(range(1, len(u)))
    while left:
        order.append(max(left, key=lambda j: (cos[order[-1], j], -j)))
        left.remove(order[-1])
    return u[order]


def _blocks(df: DataFrame, id_col: str, group: str | None, block_rows: int, pivots: dict[int, np.ndarray], marks: str | None = None) -> DataFrame:
    """Blocks of near rows of one group: block, size (of a vector), grp, ids, cuts,
    least (the smallest cutoff), flat (the vectors), center and reach (the angle
    of its farthest row), and marks (of its rows, an array of longs each, if given)."""
    grp = F.col(group) if group else F.lit(0)
    marked = F.col(marks) if marks else F.array().cast("array<long>")
    rows = _taking_part(df, group).select(grp.alias("grp"), F.size("u").alias("size"), F.col(id_col).alias("id"), F.col("_cut").alias("cut"), "u", marked.alias("marks"))
    g_type, i_type = rows.schema["grp"].dataType, rows.schema["id"].dataType

    def matrix(col) -> np.ndarray:
        return col.flatten().to_numpy(zero_copy_only=False)

    def near(batches):
        for b in batches:
            size = b.column(1).to_numpy()
            flat, starts = matrix(b.column(4)), np.cumsum(size) - size
            p, s = np.zeros(len(size), np.int32), np.zeros(len(size))
            for n, of in pivots.items():
                own = np.flatnonzero(size == n)
                if len(own) and n:
                    cos = flat[starts[own][:, None] + np.arange(n)] @ of.T
                    p[own], s[own] = cos.argmax(1), cos.max(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array(s)], [*b.schema.names, "p", "s"])

    def pack(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 40
        for b in batches:
            size, grp = b.column(1).to_numpy(), b.column(0).dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero((np.diff(size) != 0) | (np.diff(grp) != 0)) + 1
            for lo, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)]):
                n = int(size[lo]) if end > lo else 0
                step = max(1, min(block_rows, BLOCK_VALUES // max(n, 1)))
                for a in range(lo, end, step):
                    own = b.slice(a, min(step, end - a))
                    u = matrix(own.column(4)).reshape(own.num_rows, n)
                    mean = u.mean(0)
                    length = float(np.linalg.norm(mean))
                    center = mean / length if length > 0 else mean
                    reach = float(np.arccos(np.clip((u @ center).min(), -1, 1))) if length > 0 else float(np.pi)
                    cut, marks_ = own.column(3).to_numpy(zero_copy_only=False), own.column(5).flatten()
                    yield pa.RecordBatch.from_pydict({
                        "block": [block], "size": [n], "grp": own.column(0).slice(0, 1), "ids": pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column(2)),
                        "cuts": [cut.tolist()], "least": [float(np.nanmin(cut)) if not np.isnan(cut).all() else None], "flat": pa.ListArray.from_arrays(pa.array([0, u.size], pa.int32()), pa.array(u.reshape(-1))),
                        "center": [center.tolist()], "reach": [reach], "marks": pa.ListArray.from_arrays(pa.array([0, len(marks_)], pa.int32()), marks_),
                    }, schema=schema)
                    block += 1

    g_arrow, i_arrow = to_arrow_type(g_type), to_arrow_type(i_type)
    schema = pa.schema([("block", pa.int64()), ("size", pa.int32()), ("grp", g_arrow), ("ids", pa.list_(i_arrow)), ("cuts", pa.list_(pa.float64())), ("least", pa.float64()), ("flat", pa.list_(pa.float64())), ("center", pa.list_(pa.float64())), ("reach", pa.float64()), ("marks", pa.list_(pa.int64()))])
    g, i = g_type.simpleString(), i_type.simpleString()
    placed = rows.mapInArrow(near, f"grp {g}, size int, id {i}, cut double, u array<double>, marks array<long>, p int, s double")
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = placed.repartitionByRange(tasks, "grp", "size", "p", "s", "id").sortWithinPartitions("grp", "size", "p", "s", "id")
    return settle(dealt.mapInArrow(pack, f"block long, size int, grp {g}, ids array<{i}>, cuts array<double>, least double, flat array<double>, center array<double>, reach double, marks array<long>"))


def strips(left_blocks: int, right_blocks: int, tasks: int) -> tuple[int, int]:
    """Strips of either side: as many pairs of them as tasks, or as tasks of
    TASK_PAIRS pairs of blocks, and no more strips than blocks. A left block is
    copied once per right strip and a right one once per left strip."""
    wanted = max(tasks, -(-left_blocks * right_blocks // TASK_PAIRS))
    share = (left_blocks / max(right_blocks, 1)) ** 0.5
    a = min(max(1, round(wanted**0.5 * share)), max(left_blocks, 1))
    return a, min(max(1, -(-wanted // a)), max(right_blocks, 1))


def block_pairs(left: DataFrame, right: DataFrame, once: bool = False) -> DataFrame:
    """Pairs of blocks of one group that may hold rows above the cutoff, the
    columns suffixed 0 and 1; with ``once``, of two equal sides, each pair once."""
    spark = left.sparkSession
    a, b = strips(left.count(), right.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = lambda k: F.pmod(F.xxhash64("block"), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    one = left.withColumn("i", place(a)).withColumn("j", each(b)).withColumnsRenamed({c: c + "0" for c in left.columns})
    two = right.withColumn("l", place(b)).withColumn("k", each(a)).withColumnsRenamed({c: c + "1" for c in right.columns})
    apart = F.acos(F.least(F.greatest(F.aggregate(F.zip_with("center0", "center1", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), F.lit(-1.0)), F.lit(1.0)))
    closest = F.cos(F.greatest(apart - F.col("reach0") - F.col("reach1") - F.lit(SLACK), F.lit(0.0)))
    fits = (F.col("grp0") == F.col("grp1")) & (F.col("size0") == F.col("size1")) & (F.col("i") == F.col("k")) & (F.col("j") == F.col("l")) & (closest + F.lit(SLACK) > F.col("least0"))
    if once:
        fits = fits & (F.col("block0") <= F.col("block1"))
    return one.join(two.hint("merge"), fits)


def _scored(left: DataFrame, right: DataFrame, q_type, d_type, query_id: str, db_id: str, group: str | None, once: bool = False) -> DataFrame:
    g_type = left.schema["grp"].dataType
    q, d, g = (t.simpleString() for t in (q_type, d_type, g_type))
    schema = pa.schema([("q", to_arrow_type(q_type)), ("d", to_arrow_type(d_type)), ("cos", pa.float64()), ("grp", to_arrow_type(g_type))])

    def run(batches):
        for b in batches:
            at = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            for r in range(b.num_rows):
                n = at["size0"][r].as_py()
                q_ids, d_ids = at["ids0"][r].values, at["ids1"][r].values
                u = at["flat0"][r].values.to_numpy(zero_copy_only=False).reshape(len(q_ids), n)
                v = at["flat1"][r].values.to_numpy(zero_copy_only=False).reshape(len(d_ids), n)
                cut = np.round(at["cuts0"][r].values.to_numpy(zero_copy_only=False), DIGITS)
                cos = u @ v.T
                shown = np.round(cos, DIGITS)
                ok = shown > cut[:, None]
                if once:
                    x, y = q_ids.to_numpy(zero_copy_only=False), d_ids.to_numpy(zero_copy_only=False)
                    ok &= (x[:, None] < y) if at["block0"][r].as_py() == at["block1"][r].as_py() else (x[:, None] != y)
                i, j = np.nonzero(ok)
                if len(i):
                    same = pa.array(np.zeros(len(i), np.int32))
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(i)), d_ids.take(pa.array(j)), pa.array(cos[i, j]), at["grp0"].slice(r, 1).take(same)], schema=schema)

    pairs = block_pairs(left, right, once).select("block0", "block1", "size0", "grp0", "ids0", "ids1", "cuts0", "flat0", "flat1")
    found = pairs.mapInArrow(run, f"q {q}, d {d}, cos double, grp {g}").withColumnsRenamed({"q": query_id, "d": db_id})
    return found.withColumnRenamed("grp", group) if group else found.drop("grp")


def _strips_met(left: DataFrame, right: DataFrame, columns: Sequence[str], run, schema: str) -> DataFrame:
    """What ``run`` makes of the blocks of a strip of either side (Arrow tables).

    Blocks go to a task once and not once a pair: most of a pair's time would be its
    way there. A task holds STRIP_BLOCKS blocks of a side on average at most.
    """
    n, m = left.count(), right.count()
    a, b = strips(n, m, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    a, b = max(a, -(-n // STRIP_BLOCKS)), max(b, -(-m // STRIP_BLOCKS))
    place = lambda k: F.pmod(F.xxhash64("block"), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    one = left.select(*columns, place(a).alias("i"), each(b).alias("j"))
    two = right.select(*columns, each(a).alias("i"), place(b).alias("j"))
    # As many tasks as pairs of strips, that a task has not many of them at once.
    deal = lambda d: d.repartition(a * b, "i", "j").groupBy("i", "j")
    return deal(one).cogroup(deal(two)).applyInArrow(run, schema)


def _array(table: pa.Table, column: str, row: int) -> np.ndarray:
    return table.column(column)[row].values.to_numpy(zero_copy_only=False)


def _room(n: int) -> float:
    """How far a cosine in single precision may be off, with room for rounding."""
    return (n + 8) * 2.0**-22


def _nearest(left: DataFrame, right: DataFrame, q_type, d_type, query_id: str, db_id: str, group: str | None, best: int, folds: int | None) -> DataFrame:
    g_type = left.schema["grp"].dataType
    schema = pa.schema([("q", to_arrow_type(q_type)), ("d", to_arrow_type(d_type)), ("cos", pa.float64()), ("grp", to_arrow_type(g_type))])

    def highest(i, cos, d):
        """Places of the first ``best`` of each i, by cos and then d."""
        order = np.lexsort((d, -cos, i))
        start = np.flatnonzero(np.diff(i[order], prepend=-1))
        rank = np.arange(len(i)) - np.repeat(start, np.diff([*start, len(i)]))
        if not np.issubdtype(d.dtype, np.integer):  # ties of other ids are all kept
            last = np.minimum(start + best, np.append(start[1:], len(i))) - 1
            return order[cos[order] >= np.repeat(cos[order][last], np.diff([*start, len(i)]))]
        return order[rank < best]

    def run(one, two):
        made = []
        y = [two.column("ids")[s].values.to_numpy(zero_copy_only=False) for s in range(two.num_rows)]
        whole = all(np.issubdtype(x.dtype, np.integer) for x in y)
        kinds, sizes = two.column("grp").to_pylist(), two.column("size").to_pylist()
        v = [_array(two, "flat", s).reshape(len(y[s]), sizes[s]) for s in range(two.num_rows)]
        v32 = [x.astype(np.float32) for x in v]
        every, starts = pa.concat_arrays([two.column("ids")[s].values for s in range(two.num_rows)] or [pa.array([], schema.field("d").type)]), np.cumsum([0, *map(len, y)])
        for r in range(one.num_rows):
            n, kind, x, cut = one.column("size")[r].as_py(), one.column("grp")[r].as_py(), one.column("ids")[r].values.to_numpy(zero_copy_only=False), np.round(_array(one, "cuts", r), DIGITS)
            u = _array(one, "flat", r).reshape(len(x), n)
            u32, top = u.astype(np.float32), np.full((len(x), best), -np.inf)
            held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64 if whole else float), np.zeros(0, np.int64), np.zeros(0, np.int64)]
            for s in range(two.num_rows):
                if sizes[s] != n or kinds[s] != kind:
                    continue
                least = top.min(1)
                hit = u32 @ v32[s].T >= (least - _room(n)).astype(np.float32)[:, None]
                if np.count_nonzero(hit) > 16 * best * len(x):  # at first, or among many equal vectors
                    shown = np.round(u @ v[s].T, DIGITS)
                    apart = (x[:, None] != y[s]) if folds is None else (x % folds)[:, None] != y[s] % folds
                    shown = np.where(apart & (shown > cut[:, None]), shown, -np.inf)
                    kth = np.partition(shown, -best, axis=1)[:, -best, None] if shown.shape[1] > best else -np.inf
                    i, j = np.nonzero((shown >= np.maximum(kth, least[:, None])) & (shown > -np.inf))
                    cos = shown[i, j]
                else:
                    i, j = np.nonzero(hit)
                    ok = (x[i] != y[s][j]) if folds is None else x[i] % folds != y[s][j] % folds
                    i, j = i[ok], j[ok]
                    cos = np.round(np.einsum("ij,ij->i", u[i], v[s][j]), DIGITS)
                    ok = (cos > cut[i]) & (cos >= least[i])
                    i, j, cos = i[ok], j[ok], cos[ok]
                if not len(i):
                    continue
                d = y[s][j].astype(np.int64) if whole else np.zeros(len(j))
                held = [np.concatenate(c) for c in zip(held, (i, cos, d, np.full(len(i), s), j))]
                kept = highest(*held[:3])
                held = [c[kept] for c in held]
                start = np.flatnonzero(np.diff(held[0], prepend=-1))
                rank = np.arange(len(kept)) - np.repeat(start, np.diff([*start, len(kept)]))
                few = rank < best
                top[held[0][few], rank[few]] = held[1][few]
            i, cos, _, s, j = held
            if len(i):
                ids = every.take(pa.array(starts[s] + j))
                made.append(pa.Table.from_arrays([one.column("ids")[r].values.take(pa.array(i)), ids, pa.array(cos), pa.array([kind] * len(i), schema.field("grp").type)], schema=schema))
        return pa.concat_tables(made) if made else schema.empty_table()

    q, d, g = (t.simpleString() for t in (q_type, d_type, g_type))
    found = _strips_met(left, right, ["size", "grp", "ids", "cuts", "flat"], run, f"q {q}, d {d}, cos double, grp {g}").withColumnsRenamed({"q": query_id, "d": db_id})
    return found.withColumnRenamed("grp", group) if group else found.drop("grp")


def marked_reach(queries: DataFrame, db: DataFrame, levels: Sequence[tuple[float, Sequence[int]]], id_col: str = "id", pivots: dict[int, np.ndarray] | None = None) -> DataFrame:
    """Bits that rows of ``db`` get from similar queries, one row per id with any:
    id and marks.

    Both sides have u and marks, words of 63 bits. A level is a cutoff with the
    words of the bits that it rules: a row of ``db`` gets those of its own marks
    that a query has whose cosine to it is above the cutoff. Pairs are never
    written: a task adds up what its blocks reach and asks no further for bits
    that a row has got.
    """
    pivots, width = _pivots(db, None) if pivots is None else pivots, len(levels[0][1])
    has = lambda words: F.exists(F.arrays_zip("marks", F.array(*[F.lit(int(w)) for w in words]).alias("own")), lambda x: x["marks"].bitwiseAND(x["own"]) != 0)
    lowest = F.array_min(F.array(*[F.when(has(words), F.lit(float(c))) for c, words in levels]))
    left = _blocks(queries.withColumn("_cut", lowest), id_col, None, BLOCK_ROWS, pivots, "marks")
    right = _blocks(db.withColumn("_cut", F.lit(0.0)), id_col, None, BLOCK_ROWS, pivots, "marks")
    kind = _kind(db, id_col)
    schema = pa.schema([("id", to_arrow_type(kind)), *[(f"w{i}", pa.int64()) for i in range(width)]])
    bits = [(round(float(c), DIGITS), np.array(words, np.int64)) for c, words in levels]

    def run(one, two):
        made, asking = [], []
        for r in range(one.num_rows):
            if one.column("least")[r].is_valid:
                u = _array(one, "flat", r).reshape(-1, one.column("size")[r].as_py())
                asking.append((_array(one, "marks", r).reshape(-1, width), u, u.astype(np.float32), _array(one, "center", r), one.column("reach")[r].as_py(), one.column("least")[r].as_py()))
        for s in range(two.num_rows):
            n, center, reach = two.column("size")[s].as_py(), _array(two, "center", s), two.column("reach")[s].as_py()
            v, wanted = _array(two, "flat", s).reshape(-1, n), _array(two, "marks", s).reshape(-1, width).copy()
            v32, got = v.astype(np.float32), np.zeros_like(wanted)
            for fresh, u, u32, at, around, least in asking:
                if u.shape[1] != n:
                    continue
                asked, open_ = np.bitwise_or.reduce(fresh), np.bitwise_or.reduce(wanted)
                cuts = [(cut, words) for cut, words in bits if (asked & open_ & words).any()]
                apart = np.arccos(np.clip(center @ at, -1, 1)) - reach - around - SLACK
                if not cuts or np.cos(max(apart, 0)) + SLACK <= least:
                    continue
                i, j = np.flatnonzero((fresh & open_).any(1)), np.flatnonzero((wanted & asked).any(1))
                single = v32[j] @ u32[i].T
                d, q = np.nonzero(single > np.float32(min(cut for cut, _ in cuts) - _room(n)))
                cos = single[d, q].astype(float)
                near = np.flatnonzero(np.any([np.abs(cos - cut) <= _room(n) for cut, _ in cuts], axis=0))
                cos[near] = np.round(np.einsum("ij,ij->i", v[j[d[near]]], u[i[q[near]]]), DIGITS)
                for cut, words in cuts:
                    above = np.flatnonzero(cos > cut)
                    if len(above):
                        start = np.flatnonzero(np.diff(d[above], prepend=-1))
                        row = j[d[above[start]]]
                        new = np.bitwise_or.reduceat(fresh[i[q[above]]] & words, start, axis=0) & wanted[row]
                        got[row] |= new
                        wanted[row] &= ~new
            some = np.flatnonzero(got.any(1))
            made.append(pa.Table.from_arrays([two.column("ids")[s].values.take(pa.array(some)), *[pa.array(got[some, w]) for w in range(width)]], schema=schema))
        return pa.concat_tables(made) if made else schema.empty_table()

    columns = ["size", "ids", "flat", "marks", "center", "reach", "least"]
    found = _strips_met(left, right, columns, run, f"id {kind.simpleString()}, " + ", ".join(f"w{i} long" for i in range(width)))
    return found.groupBy("id").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(width)]).select(F.col("id").alias(id_col), F.array(*[f"w{i}" for i in range(width)]).alias("marks"))


def nearest_vote(df: DataFrame, id_col: str, label: str, k: int = 5, folds: int | None = None) -> DataFrame:
    """The majority label of each row's k most similar other rows; ties go to
    the smaller label, equal cosines to the smaller id. With ``folds``, rows of
    one fold (id modulo folds) are no neighbours of each other.
    """
    own = df.select(F.col(id_col).alias("q"), "u", F.col(label).alias("truth"))
    other = df.select(F.col(id_col).alias("d"), "u", F.col(label).alias("vote"))
    near = similarity_join(own, other, -2.0, "q", "d", best=k, folds=folds).withColumn("cos", F.round("cos", DIGITS))
    w = Window.partitionBy("q").orderBy(F.desc("cos"), "d")
    top = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).join(other.select("d", "vote"), "d")
    votes = top.groupBy("q", "vote").agg(F.count("*").alias("n"))
    best = votes.groupBy("q").agg(F.min_by("vote", F.struct(-F.col("n"), "vote")).alias("predicted"))
    return own.select("q", "truth").join(best, "q").withColumnRenamed("q", id_col)


def per_dimension(df: DataFrame, keys: Sequence[str], vector: Column, **aggs) -> DataFrame:
    """Aggregates of each component: keys, dim and one column per aggregate.

    A value is a function of the component's column. Partial aggregation keeps
    the shuffle at one row per key, dimension and task.
    """
    long = df.select(*keys, F.posexplode(vector).alias("dim", "x"))
    return long.groupBy(*keys, "dim").agg(*[f(F.col("x")).alias(name) for name, f in aggs.items()])


def mean_pool(df: DataFrame, keys: Sequence[str], vector: Column) -> DataFrame:
    """Mean vector of each group."""
    dims = per_dimension(df, keys, vector, m=F.avg)
    return dims.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean"))


def softmax_pool(df: DataFrame, keys: Sequence[str], score: Column, vector: Column) -> DataFrame:
    """tanh of each group's vectors, weighted by the softmax of the scores."""
    top = df.groupBy(*keys).agg(F.max(score).alias("_top"))
    weighed = df.withColumn("_s", score).withColumn("_v", vector).join(top, list(keys)).withColumn("_w", F.exp(F.col("_s") - F.col("_top")))
    dims = weighed.select(*keys, "_w", F.posexplode("_v").alias("dim", "x")).groupBy(*keys, "dim").agg(F.tanh(F.sum(F.col("_w") * F.col("x")) / F.sum("_w")).alias("m"))
    return dims.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("pooled"))
