"""Seeded sampling and fold assignment. Order comes from hashes of keys, so a
sample does not depend on how rows are partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running
from .settle import settle

#: The modulus and the two factors of ``mixed``.
PRIME, ONE, TWO = 2_147_483_647, 48_271, 69_621
#: Hashes are counted in runs of so many bits.
RUN_BITS = 20
#: Rows that are sent to every task rather than shuffled, at most.
SENT_ROWS = 100_000


def mixed(key: Column, seed: int | Column = 0) -> Column:
    """An integer hash that any SQL engine can compute: two rounds modulo a prime."""
    one = F.pmod(key.cast("long") * ONE + (seed * 7919 + 11), F.lit(PRIME))
    return F.pmod(one * TWO + 1, F.lit(PRIME))


def array_split(rank: Column, total: Column, parts: int) -> Column:
    """The chunk of a row by rank (from 0): contiguous, the first ones one longer."""
    q, r = F.floor(total / parts), F.pmod(total, F.lit(parts))
    head = r * (q + 1)
    return F.when(rank < head, F.floor(rank / (q + 1))).otherwise(r + F.floor((rank - head) / F.greatest(q, F.lit(1)))).cast("int")


def ranked(df: DataFrame, order: Sequence, keys: Sequence[str] = ()) -> DataFrame:
    """Adds rn (from 0) and total within the keys, ranked in ranges of keys and
    order: no task sees all rows of a key. The order must tell rows apart."""
    return running(df, order, keys).withColumnRenamed("total_rn", "total")


def group_folds(df: DataFrame, group: str, order: str, folds: int) -> DataFrame:
    """Adds fold: groups in first-seen order are split into contiguous folds."""
    first = df.groupBy(group).agg(F.min(order).alias("_first"))
    placed = ranked(first, ["_first", group])
    return df.join(placed.select(group, array_split(F.col("rn"), F.col("total"), folds).alias("fold")), group)


def stratified_folds(df: DataFrame, stratum: str, key: str, folds: int, seed: int = 2) -> DataFrame:
    """Adds fold: rows of each stratum dealt out in hash order, ties by key."""
    placed = ranked(df, [mixed(F.col(key), seed), key], [stratum])
    return placed.withColumn("fold", F.pmod("rn", F.lit(folds)).cast("int")).drop("rn", "total")


def nested_folds(df: DataFrame, stratum: str, key: str, outer: int = 5, inner: int = 5, seed: int = 2, held_back: int | None = None, positive=1) -> DataFrame:
    """Outer and inner folds of each stratum: the outer fold a row is tested in,
    and of every other outer fold the inner one it validates: key, stratum, outer,
    role (test, train), inner (null for tests) and extra.

    Both folds come from one rank: it is dealt out to the outer folds in turn, and
    what is left without one of them to the inner folds in turn. With
    ``held_back``, only so many rows of the ``positive`` stratum, the first by
    hash, are dealt out; the others are in no fold's training rows but in every
    outer fold's validation, once (extra true, inner null).
    """
    placed = ranked(df.select(key, stratum), [mixed(F.col(key), seed), key], [stratum])
    spare = (F.col(stratum) == F.lit(positive)) & (F.col("rn") >= held_back) if held_back is not None else F.lit(False)
    own = F.pmod("rn", F.lit(outer))
    each = placed.withColumn("extra", F.coalesce(spare, F.lit(False))).withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))))
    # The rank among the rows that the outer fold does not test.
    rest = F.floor(F.col("rn") / F.lit(outer)) * (outer - 1) + own - (own > F.col("outer")).cast("long")
    test = ~F.col("extra") & (own == F.col("outer"))
    role = F.when(F.col("extra"), "validation").when(test, "test").otherwise("train")
    inner_fold = F.when(~F.col("extra") & ~test, F.pmod(rest, F.lit(inner)).cast("int"))
    return each.select(key, stratum, "outer", role.alias("role"), inner_fold.alias("inner"))


def take_hashed(df: DataFrame, n: int, key: str, keys: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """n rows of each group, without replacement, the smallest hashes first."""
    if not keys:
        return df.orderBy(mixed(F.col(key), seed), key).limit(n)
    w = Window.partitionBy(*keys)
    return df.withColumn("_r", F.row_number().over(w.orderBy(mixed(F.col(key), seed), key))).where(F.col("_r") <= n).drop("_r")


def _numbered_draws(groups: DataFrame, n: int, at_once: int = 10_000) -> DataFrame:
    """Each group with draw, the numbers from 0 to n - 1, spread over the tasks."""
    runs = groups.withColumn("_run", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // at_once))))
    if n > at_once:
        runs = runs.repartition(F.xxhash64(*groups.columns, "_run"))
    first = F.col("_run") * at_once
    return runs.withColumn("draw", F.explode(F.sequence(first, F.least(first + (at_once - 1), F.lit(n - 1))))).drop("_run")


def draws(df: DataFrame, n: int, key: str, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """n draws with replacement from each group's rows: draw and the row's columns."""
    placed = ranked(df, [key], keys)
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(key).alias("_k"))
    picks = _numbered_draws(sizes, n).withColumn("rn", F.pmod(mixed(F.col("_k") * n + F.col("draw"), seed), F.col("_n")))
    return picks.select(*keys, "draw", F.col("rn").cast("long")).join(placed.withColumn("rn", F.col("rn").cast("long")).drop("total"), [*keys, "rn"]).drop("rn")


def random_pairs(df: DataFrame, n: int, key: str, group: str, seed: int = 0) -> DataFrame:
    """n draws of two different rows of each group: group, draw, a, b.

    Pairs may repeat between draws. Groups of one row give none.
    """
    placed = ranked(df.select(group, key), [key], [group])
    sizes = placed.groupBy(group).agg(F.count("*").alias("_n"), F.min(key).alias("_k")).where("_n > 1")
    drawn = _numbered_draws(sizes, n)
    i = F.pmod(mixed(F.col("_k") * n + F.col("draw"), seed), F.col("_n"))
    j = F.pmod(mixed(F.col("_k") * n + F.col("draw"), seed + 1), F.col("_n") - 1)
    drawn = drawn.select(group, "draw", i.cast("long").alias("_i"), F.when(j >= i, j + 1).otherwise(j).cast("long").alias("_j"))
    row = placed.select(group, key, F.col("rn").cast("long").alias("rn"))
    left = drawn.join(row.select(group, F.col("rn").alias("_i"), F.col(key).alias("a")), [group, "_i"])
    return left.join(row.select(group, F.col("rn").alias("_j"), F.col(key).alias("b")), [group, "_j"]).select(group, "draw", "a", "b")


def drawn_negatives(left: DataFrame, right: DataFrame, positives: DataFrame, wanted: DataFrame, residue: Sequence[str], keys: Sequence[str], seed: int = 0, start: Column | None = None, distinct: bool = False) -> DataFrame:
    """``wanted`` (keys, wanted) pairs of each group that are no positive ones, or
    all there are: keys and the residue's columns, suffixed 0 and 1.

    A pair has a number: that of its left residue times the right ones, plus that
    of its right one. Numbers are drawn in steps of a prime that doesn't divide
    their count, so none comes twice: as many as are wanted and positive hold
    enough negative ones. No product of the sides is made, and draws are made a few
    at first and more only where too many of them were positive. ``distinct`` says
    that no positive pair comes twice.
    """
    primes = (2_147_483_647, 48_271, 69_623)
    sides, sizes = [], wanted
    for side, x in (("0", left), ("1", right)):
        own = ranked(x.select(*keys, *residue).distinct(), residue, keys)
        sides.append(settle(own.select(*keys, *[F.col(c).alias(c + side) for c in residue], F.col("rn").alias("_r" + side))))
        sizes = sizes.join(sides[-1].groupBy(*keys).agg(F.count("*").alias("_n" + side)), list(keys))
    columns = [*keys, *[c + s for s in "01" for c in residue]]
    known = positives.select(*columns)
    if not distinct:
        known = settle(known.distinct())
    sizes = sizes.join(known.groupBy(*keys).agg(F.count("*").alias("_pos")), list(keys), "left").fillna(0, ["_pos"])
    total = F.col("_n0") * F.col("_n1")
    step = F.coalesce(*[F.when(total % p != 0, F.lit(p).cast("long")) for p in primes], F.lit(1).cast("long"))
    if start is None:
        start = F.pmod(F.xxhash64(*keys), F.lit(1_000_003)) if keys else F.lit(0)
    sizes = sizes.withColumn("wanted", F.least(F.col("wanted"), total - F.col("_pos"))).where("wanted > 0").withColumns({"_step": step, "_start": mixed(start, seed)})
    # _to: the numbers drawn so far; all are at most those of wanted and positive pairs.
    open_, found = settle(sizes.withColumn("_to", F.lit(0).cast("long"))), None
    while not open_.isEmpty():
        more = open_.withColumn("_from", F.col("_to")).withColumn("_to", F.least(F.col("_to") * 4 + F.col("wanted") * 2, F.col("wanted") + F.col("_pos")))
        place = F.pmod(F.col("_step") * F.col("_i") + F.col("_start"), total)
        draws_ = _numbers_between(more, "_from", "_to", keys).select(*keys, "_i", F.floor(place / F.col("_n1")).alias("_r0"), F.pmod(place, F.col("_n1")).alias("_r1"))
        pairs = settle(draws_.join(sides[0], [*keys, "_r0"]).join(sides[1], [*keys, "_r1"]).select(*columns, "_i"))
        free = settle(without(pairs, known, columns))
        found = free if found is None else found.unionByName(free)
        got = found.groupBy(*keys).agg(F.count("*").alias("_got"))
        short = more.join(got, list(keys), "left") if keys else more.crossJoin(got)
        open_ = settle(short.where((F.coalesce(F.col("_got"), F.lit(0)) < F.col("wanted")) & (F.col("_to") < F.col("wanted") + F.col("_pos"))).drop("_got", "_from"))
    if found is None:
        return sides[0].join(sides[1], list(keys)).select(*columns).limit(0) if keys else sides[0].crossJoin(sides[1]).select(*columns).limit(0)
    first = Window.partitionBy(*keys).orderBy("_i")
    ranked_ = found.join(sizes.select(*keys, "wanted"), list(keys)) if keys else found.crossJoin(sizes.select("wanted"))
    return ranked_.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= F.col("wanted")).select(*columns)


def _numbers_between(groups: DataFrame, low: str, high: str, keys: Sequence[str], at_once: int = 10_000) -> DataFrame:
    """Each group with _i, the numbers from ``low`` to ``high`` - 1, spread over the tasks."""
    runs = groups.where(F.col(low) < F.col(high)).withColumn("_at", F.explode(F.sequence(F.col(low), F.col(high) - 1, F.lit(at_once).cast("long"))))
    runs = runs.repartition(F.xxhash64(*keys, "_at"))
    return runs.withColumn("_i", F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + at_once, F.col(high)) - 1))).drop("_at")


def without(rows: DataFrame, known: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The settled ``rows`` that are not known; few of them go to every task, so
    that the known ones, of which there may be many, are not shuffled."""
    few = rows.count() <= SENT_ROWS
    asked = rows.select(*columns).distinct()
    hit = known.join(F.broadcast(asked) if few else asked, list(columns), "left_semi").distinct()
    return rows.join(hit, list(columns), "left_anti")


def first_hashed(df: DataFrame, n: int, hashed: Column, order: Sequence, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """n rows of each group, the smallest hashes of ``hashed`` first, ties by ``order``.

    Hashes are counted in runs, and only rows of the runs that hold the first n are
    ordered: no task sorts or holds a group's other rows.
    """
    own = df.withColumn("_h", mixed(hashed, seed))
    run = F.coalesce(F.shiftright("_h", RUN_BITS), F.lit(-1))
    counts = own.groupBy(*keys, run.alias("_run")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_run")) - F.col("_n")
    last = counts.withColumn("_before", before).where(F.col("_before") < n).groupBy(*keys).agg(F.max("_run").alias("_last"))
    near = own.join(F.broadcast(last), list(keys)).where(run <= F.col("_last"))
    w = Window.partitionBy(*keys).orderBy("_h", *order)
    return near.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).select(*df.columns)


def hashed_negatives(left: DataFrame, right: DataFrame, positives: DataFrame, residue: str, scale: int, n: int, seed: int = 0) -> DataFrame:
    """Of all pairs of the sides' residues (whole numbers) that are no positive ones,
    the first n by the hash of k, the left number times ``scale`` plus the right
    one: residue0, residue1, k. Positive pairs are distinct, of the sides' residues.

    The hash of a sum is the sum of two hashes modulo a prime. So a left residue
    meets the right ones whose hash leaves the sum below a bound, on runs of hashes
    as long as it; the bound grows until n are found. No product is made.
    """
    one, two = residue + "0", residue + "1"
    a = settle(left.select(F.col(residue).alias(one)).where(F.col(one).isNotNull()).distinct().withColumn("_u", mixed(F.col(one) * scale, seed)))
    b = settle(right.select(F.col(residue).alias(two)).where(F.col(two).isNotNull()).distinct().withColumn("_v", F.pmod(F.pmod(F.col(two).cast("long") * ONE, F.lit(PRIME)) * TWO, F.lit(PRIME))))
    known = positives.select(one, two)
    free = a.count() * b.count() - known.count()
    key = (F.col(one) * scale + F.col(two)).alias("k")
    wanted, bound = min(n, free), PRIME if free <= 4 * n + 64 else PRIME * (4 * n + 64) // free + 1
    while wanted > 0:
        low = F.pmod(F.lit(PRIME) - F.col("_u"), F.lit(PRIME))
        runs = lambda x, y: F.when(x < y, F.sequence(F.floor(x / bound), F.floor((y - 1) / bound))).otherwise(F.array().cast("array<bigint>"))
        near = F.array_distinct(F.concat(runs(low, F.least(low + bound, F.lit(PRIME))), runs(F.lit(0).cast("long"), low + bound - PRIME)))
        met = a.withColumn("_run", F.explode(near)).join(b.withColumn("_run", F.floor(F.col("_v") / bound)), "_run")
        met = settle(met.withColumn("_h", F.pmod(F.col("_u") + F.col("_v"), F.lit(PRIME))).where(F.col("_h") < bound).select(one, two, "_h"))
        found = settle(without(met, known, [one, two]).select(one, two, key, "_h"))
        if bound >= PRIME or found.count() >= wanted:
            return found.orderBy("_h", "k").limit(n).drop("_h")
        bound = min(bound * 4, PRIME)
    return a.crossJoin(b).select(one, two, key).limit(0)


def label_sample(positives: DataFrame, negatives: DataFrame, key: str, n: int = 10, ratio: int = 1, seed: int = 0) -> DataFrame:
    """Up to n positives and ratio times as many negatives, with label 1 and 0."""
    pos = take_hashed(positives, n, key, seed=seed).withColumn("label", F.lit(1))
    taken = pos.count()
    return pos.unionByName(take_hashed(negatives, taken * ratio, key, seed=seed).withColumn("label", F.lit(0)))
