"""Statistics over the cosines of all pairs of a group, or of a row with a whole
side, without writing the pairs.

There are as many pairs as the square of the rows, so each pass scores the blocks
of vectors again and hands on counts: histograms, made finer only where a wanted
rank lies, until few values are left there. Sums grow with the number of tasks,
groups and bins, not with the pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .settle import settle
from .vectors import BLOCK_ROWS, DIGITS, block_pairs, packed

#: Bins of a histogram; values of a bin that are ordered at last; histograms within
#: histograms at most (then a bin is narrower than a double's last digit near 1).
BINS = 1 << 14
LAST_VALUES = 1 << 16
DEPTH = 4
#: Histograms that a task holds at once.
HELD = 64
#: Highest values of one side's rows that a task holds at once, and values that are
#: looked at together.
HELD_VALUES = 1 << 22
#: Cosines lie between these, rounding included.
LOW, HIGH = -1.0 - 2.0**-20, 1.0 + 2.0**-20


def _binned(values: np.ndarray, path: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the values that lie in the bins of the path, one within the other: which
    they are (the values themselves) and their bin one step deeper."""
    low, width = LOW, HIGH - LOW
    for step in [*path, None]:
        width /= BINS
        bins = np.clip(np.floor((values - low) / width), 0, BINS - 1).astype(np.int64)
        if step is not None:
            values = values[bins == step]
            low += step * width
    return values, bins


def _edge(path: Sequence[int]) -> float:
    low, width = LOW, HIGH - LOW
    for step in path:
        width /= BINS
        low += step * width
    return low


class PairScores:
    """The cosines of all unordered pairs of rows of one group (``group``: few
    values, such as residue types). Rows with equal ids are no pair."""

    def __init__(self, df: DataFrame, id_col: str, group: str, block_rows: int = BLOCK_ROWS):
        self.spark, self.group, self.kind = df.sparkSession, group, df.schema[group].dataType
        self.blocks = packed(df, id_col, group, block_rows).withColumn("least", F.lit(-2.0))

    def _passed(self, schema: str, start, add, end) -> DataFrame:
        """Rows of the group and ``schema`` that a task makes of its pairs of blocks:
        ``add(state, values)`` for each pair, ``end(state)`` gives columns."""
        arrow = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        fields = pa.schema([("grp", to_arrow_type(self.kind)), *[(x.split()[0], arrow[x.split()[1]]) for x in schema.split(", ")]])

        def run(batches):
            held: dict = {}

            def given(key):
                columns = end(held.pop(key))
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(columns[0]), fields.field(0).type), *[pa.array(c, fields.field(i + 1).type) for i, c in enumerate(columns)]], schema=fields)

            for b in batches:
                at = {c: b.column(i) for i, c in enumerate(b.schema.names)}
                for r in range(b.num_rows):
                    n, grp = at["size0"][r].as_py(), at["grp0"][r].as_py()
                    x, y = (at[f"ids{i}"][r].values.to_numpy(zero_copy_only=False) for i in (0, 1))
                    u, v = (at[f"flat{i}"][r].values.to_numpy(zero_copy_only=False).reshape(-1, n) for i in (0, 1))
                    ok = (x[:, None] < y) if at["block0"][r].as_py() == at["block1"][r].as_py() else (x[:, None] != y)
                    if grp not in held:
                        if len(held) >= HELD:
                            yield from given(next(iter(held)))
                        held[grp] = start()
                    add(held[grp], (u @ v.T)[ok], grp)
            for key in list(held):
                yield from given(key)

        pairs = block_pairs(self.blocks, self.blocks, once=True).select("block0", "block1", "size0", "grp0", "ids0", "ids1", "flat0", "flat1")
        kinds = self.kind.simpleString()
        return pairs.mapInArrow(run, f"grp {kinds}, {schema}")

    def _counts(self, cells: dict | None) -> DataFrame:
        """grp, cell, bin, n: of the cells (number: whose they are, path) of each group, or of all values."""

        def add(state, values, grp):
            for cell, (own, path) in (cells or {0: (None, ())}).items():
                if own is None or own[0] == grp:
                    inside, bins = _binned(values, path)
                    if len(inside):
                        state[cell] = state.get(cell, 0) + np.bincount(bins, minlength=BINS)

        def end(state):
            some = [(c, np.flatnonzero(n)) for c, n in state.items()]
            return [np.repeat([c for c, _ in some], [len(i) for _, i in some]), np.concatenate([i for _, i in some] or [[]]), np.concatenate([state[c][i] for c, i in some] or [[]])]

        found = self._passed("cell int, bin int, n long", dict, add, end)
        return settle(found.groupBy("grp", "cell", "bin").agg(F.sum("n").alias("n")))

    def quantiles(self, levels: Sequence[float], combined: bool = False) -> DataFrame:
        """group, level and quantile, linearly interpolated, exactly; with ``combined``
        those of all pairs too, with a null group."""
        counts = self._counts(None)
        sets = [counts.select(F.col("grp").alias("g"), F.lit(False).alias("all"), "bin", "n")]
        if combined:
            sets.append(counts.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast(self.kind).alias("g"), F.lit(True).alias("all"), "bin", "n"))
        first = sets[0] if len(sets) == 1 else sets[0].unionByName(sets[1])
        sizes = {(r["g"], r["all"]): r["size"] for r in first.groupBy("g", "all").agg(F.sum("n").alias("size")).collect()}
        # open: the set, the path of bins, how many values are below it and the rank.
        asked = {s: sorted({min(int(np.floor(x * (size - 1))) + d, size - 1) for x in levels for d in (0, 1)}) for s, size in sizes.items()}
        if not asked:
            return self.spark.createDataFrame([], f"{self.group} {self.kind.simpleString()}, level double, quantile double")
        cells = {i: (s, ()) for i, s in enumerate(asked)}
        wanted = [(i, s, 0, r) for i, s in enumerate(asked) for r in asked[s]]
        number = {s: i for i, s in enumerate(asked)}
        of_set = F.coalesce(*[F.when(F.col("g").eqNullSafe(F.lit(s[0])) & (F.col("all") == F.lit(s[1])), i) for s, i in number.items()])
        binned, value = first.select(of_set.alias("cell"), "bin", "n"), {}
        for depth in range(1, DEPTH + 1):
            ranks = self.spark.createDataFrame([(i, int(r - below), int(r)) for i, _, below, r in wanted], "c int, at long, r long")
            w = Window.partitionBy("cell").orderBy("bin")
            upto = binned.withColumn("upto", F.sum("n").over(w))
            hit = upto.join(F.broadcast(ranks), (F.col("cell") == F.col("c")) & (F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at"))).collect()
            below_of = {(i, r): below for i, _, below, r in wanted}
            paths, opened, sized = {}, [], {}
            for x in hit:
                own, path = cells[x["cell"]]
                key = (own, (*path, x["bin"]))
                at = paths.setdefault(key, len(paths))
                sized[at] = x["n"]
                opened.append((at, own, below_of[x["cell"], x["r"]] + x["upto"] - x["n"], x["r"]))
            cells, wanted = {i: key for key, i in paths.items()}, opened
            if depth == DEPTH:
                value |= {(s, r): _edge(cells[i][1]) for i, s, _, r in wanted}
                break
            if max(sized.values()) <= LAST_VALUES:
                value |= self._ordered(cells, wanted)
                break
            binned = self._counts({i: (None if s[1] else s, path) for i, (s, path) in cells.items()}).groupBy("cell", "bin").agg(F.sum("n").alias("n"))
        rows = []
        for s, size in sizes.items():
            for x in levels:
                at = x * (size - 1)
                low = int(np.floor(at))
                a, b = value[s, low], value[s, min(low + 1, size - 1)]
                rows.append((s[0], float(x), float(a + (b - a) * (at - low))))
        return self.spark.createDataFrame(rows, f"{self.group} {self.kind.simpleString()}, level double, quantile double")

    def _ordered(self, cells: dict, wanted: list) -> dict:
        """The values at the wanted ranks, where cells hold few of them."""
        paths = {i: (None if s[1] else s, path) for i, (s, path) in cells.items()}

        def add(state, values, grp):
            for cell, (own, path) in paths.items():
                if own is None or own[0] == grp:
                    inside = _binned(values, path)[0]
                    if len(inside):
                        state.append((cell, inside))

        end = lambda state: [np.repeat([c for c, _ in state], [len(v) for _, v in state]), np.concatenate([v for _, v in state] or [[]])]
        w = Window.partitionBy("cell").orderBy("v")
        ranked = self._passed("cell int, v double", list, add, end).withColumn("k", F.row_number().over(w) - 1)
        ranks = self.spark.createDataFrame([(i, int(r - below), int(r)) for i, _, below, r in wanted], "c int, at long, r long")
        got = ranked.join(F.broadcast(ranks), (F.col("cell") == F.col("c")) & (F.col("k") == F.col("at"))).select("cell", "r", "v").collect()
        return {(cells[x["cell"]][0], x["r"]): x["v"] for x in got}

    def share_below(self, scores: DataFrame, score: str, name: str) -> DataFrame:
        """Adds the share of pairs of all groups whose rounded cosine is below the
        rounded score. The different scores (8 bytes each) go to every task."""
        asked = np.sort(np.array([r[0] for r in scores.select(F.round(score, DIGITS).alias("s")).where("s IS NOT NULL").distinct().collect()], float))
        sent = self.spark.sparkContext.broadcast(asked)

        def add(state, values, grp):
            state["n"] = state.get("n", 0) + np.bincount(np.searchsorted(sent.value, np.round(values, DIGITS), "right"), minlength=len(sent.value) + 1)

        end = lambda state: [np.arange(len(state["n"])), state["n"]]
        # A value of place i is below the scores from the i-th on.
        counts = settle(self._passed("place int, n long", dict, add, end).groupBy("place").agg(F.sum("n").alias("n")))
        n = np.zeros(len(asked) + 1, np.int64)
        for r in counts.where("n > 0").collect():
            n[r["place"]] = r["n"]
        total = int(n.sum())
        share = self.spark.createDataFrame([(float(s), float(c / total) if total else None) for s, c in zip(asked, np.cumsum(n))], f"_s double, {name} double")
        return scores.join(share, F.round(score, DIGITS) == F.col("_s"), "left").drop("_s")


def top_statistics(sites: DataFrame, background: DataFrame, site_id: str, id_col: str, group: str, levels: Sequence[float]) -> DataFrame:
    """Of each site's cosines to all background vectors of its group: site_id, n,
    mean, std (of the population) and quantiles, an array of level and quantile,
    linearly interpolated, exactly, in the levels' order. Sites without any are left out.

    Each task scores blocks against blocks and hands on sums and the highest values
    only, as many as the lowest level can ask for: give levels near 1.
    """
    right = packed(background, id_col, group)
    lowest = float(min(levels))
    sizes = [r["m"] for r in right.groupBy("grp", "size").agg(F.sum(F.size("ids")).alias("m")).agg(F.max("m").alias("m")).collect()]
    copies = sites.groupBy(site_id).count().agg(F.max("count")).first()[0] or 1  # ids that come again share their rows
    largest = int(sizes[0] or 0) * copies
    held = min(largest, largest - int(np.floor(lowest * max(largest - 1, 0))))
    left = packed(sites, site_id, group, max(1, min(BLOCK_ROWS, HELD_VALUES // max(held, 1)))).withColumn("least", F.lit(-2.0))
    kind = sites.schema[site_id].dataType
    fields = pa.schema([("id", to_arrow_type(kind)), ("n", pa.int64()), ("s", pa.float64()), ("q", pa.float64()), ("top", pa.list_(pa.float64()))])

    def run(batches):
        block, state = None, None

        def given():
            ids, n, s, q, top = state
            offsets = np.arange(len(ids) + 1, dtype=np.int32) * top.shape[1]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(s), pa.array(q), pa.ListArray.from_arrays(pa.array(offsets), pa.array(top.reshape(-1)))], schema=fields)

        for b in batches:
            at = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            for r in range(b.num_rows):
                width, ids = at["size0"][r].as_py(), at["ids0"][r].values
                u, v = (at[f"flat{i}"][r].values.to_numpy(zero_copy_only=False).reshape(-1, width) for i in (0, 1))
                if block != at["block0"][r].as_py():  # a join gives a block's pairs one after the other
                    if state is not None:
                        yield from given()
                    block, state = at["block0"][r].as_py(), (ids, np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids)), np.zeros((len(ids), 0)))
                cos = u @ v.T
                ids, n, s, q, top = state
                none = np.isnan(cos)
                n = n + (~none).sum(1)
                cos[none] = 0
                s, q = s + cos.sum(1), q + (cos * cos).sum(1)
                cos[none] = -np.inf
                both = np.concatenate([top, cos], 1)
                if both.shape[1] > held:
                    both = np.partition(both, both.shape[1] - held, axis=1)[:, both.shape[1] - held :]
                state = ids, n, s, q, np.ascontiguousarray(both)
        if state is not None:
            yield from given()

    pairs = block_pairs(left, right).select("block0", "size0", "ids0", "flat0", "flat1")
    parts = pairs.mapInArrow(run, f"id {kind.simpleString()}, n long, s double, q double, top array<double>")
    whole = parts.groupBy("id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sort_array(F.flatten(F.collect_list("top")), asc=False).alias("top")).where("n > 0")
    mean = F.col("s") / F.col("n")
    # The value of a rank (from 0, rising) among the highest ones.
    value = lambda rank: F.get("top", (F.col("n") - 1 - rank).cast("int"))

    def quantile(x: float):
        place = F.lit(float(x)) * (F.col("n") - 1)
        low = F.floor(place)
        a, b = value(low), value(F.least(low + 1, F.col("n") - 1))
        return F.struct(F.lit(float(x)).alias("level"), (a + (b - a) * (place - low)).alias("quantile"))

    return whole.select(F.col("id").alias(site_id), "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"), F.array(*[quantile(x) for x in levels]).alias("quantiles"))
