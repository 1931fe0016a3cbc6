"""Ranks, running sums and quantiles that no single task has to see whole.

Running sums: rows are dealt out in ranges of keys and order, whose splitters
Spark samples, so an outlier or a key with most of the rows takes no more room
than any other; what lies in lower ranges is added from a table of one row a
range and key. Quantiles: histograms of a group's values, made finer only where
a wanted rank lies, until few different values are left there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import settle

#: Bins of a histogram, and the different values of a bin that are ordered at last.
BINS = 1024
LAST_VALUES = 1 << 16
#: Rounds after which bins are ordered whatever they hold.
ROUNDS = 40


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence, ranges: int | None = None) -> DataFrame:
    """``df`` written once in ranges of keys and order, with the range in _p."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(df.repartitionByRange(max(n, 2), *keys, *order).withColumn("_p", F.spark_partition_id()))


def running(df: DataFrame, order: Sequence, keys: Sequence[str] = (), sums: dict[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """Adds for each name in ``sums`` the sum over the earlier rows of the keys,
    and total_<name>, that over all of them. The order must tell rows apart; null
    keys are keys like any other."""
    sums = sums or {"rn": F.lit(1).cast("long")}
    own = dealt(df.withColumns({f"_v_{c}": v for c, v in sums.items()}), keys, order, ranges)
    parts = own.groupBy(*keys, "_p").agg(*[F.sum(f"_v_{c}").alias(c) for c in sums])
    # A key has one element for each range it reaches into.
    lists = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", *sums))).alias("_ranges"))
    below = lambda p, c: F.aggregate(F.filter("_ranges", lambda x: x["_p"] < p["_p"]), F.lit(0).cast(parts.schema[c].dataType), lambda s, x: s + F.coalesce(x[c], F.lit(0)))
    whole = lambda c: F.aggregate("_ranges", F.lit(0).cast(parts.schema[c].dataType), lambda s, x: s + F.coalesce(x[c], F.lit(0)))
    placed = F.transform("_ranges", lambda p: F.struct(p["_p"].alias("_p"), *[below(p, c).alias(f"_b_{c}") for c in sums]))
    base = lists.select(*keys, *[whole(c).alias(f"total_{c}") for c in sums], F.explode(placed).alias("_b")).select(*keys, *[f"total_{c}" for c in sums], "_b.*")
    before = Window.partitionBy("_p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = own.withColumns({f"_s_{c}": F.coalesce(F.sum(f"_v_{c}").over(before), F.lit(0)) for c in sums})
    base = base.withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"_p": "_q"})
    on = F.col("_p") == F.col("_q")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = local.join(base, on).withColumns({c: F.col(f"_b_{c}") + F.col(f"_s_{c}") for c in sums})
    return out.select(*df.columns, *sums, *[f"total_{c}" for c in sums])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float]) -> DataFrame:
    """keys, level and quantile: linearly interpolated between the values on
    either side, exactly. Null and NaN values don't count; groups without any,
    and null keys, have no rows. Groups may be of any size and number.
    """
    v = F.col(value).cast("double")
    rows = settle(df.where(v.isNotNull() & ~F.isnan(v)).select(*[F.col(k) for k in keys], (v + F.lit(0.0)).alias("v")).where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys) or "true"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("size"), F.min("v").alias("low"), F.max("v").alias("high"))
    at = F.col("level") * (F.col("size") - 1)
    asked = sizes.select("*", F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("level"))
    asked = settle(asked.select("*", F.floor(at).alias("_r"), (at - F.floor(at)).alias("_f")))
    ranks = F.explode(F.array_distinct(F.array("_r", F.least(F.col("_r") + 1, F.col("size") - 1)))).alias("r")
    # cells: where a rank lies, as a range of values, and how many are below it.
    cells = settle(asked.select(*keys, "low", "high", "size", ranks).distinct().withColumn("below", F.lit(0).cast("long")))
    inside, found = rows.join(sizes.select(*keys, "low", "high"), list(keys)) if keys else rows.crossJoin(F.broadcast(sizes.select("low", "high"))), None
    for i in range(ROUNDS):
        # A cell of one value, or of few, is done; the others are cut into bins.
        done = cells.where((F.col("low") == F.col("high")) | (F.col("size") <= LAST_VALUES))
        found = done if found is None else found.unionByName(done)
        cells = settle(cells.where((F.col("low") < F.col("high")) & (F.col("size") > LAST_VALUES)))
        if i == ROUNDS - 1 or cells.isEmpty():
            found = found.unionByName(cells)
            break
        cell = [*keys, "low", "high"]
        live = inside.join(cells.select(*cell).distinct(), cell, "left_semi")
        share = F.try_divide(F.col("v") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2)  # halves can't overflow
        share = F.nanvl(F.coalesce(share, F.lit(0.0)), F.lit(0.0))
        live = live.withColumn("_bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        bins = live.groupBy(*cell, "_bin").agg(F.count("*").alias("n"), F.min("v").alias("_a"), F.max("v").alias("_b"))
        lower = F.coalesce(F.sum("n").over(Window.partitionBy(*cell).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = bins.withColumn("_u", lower)  # BINS rows a cell
        near = cells.join(bins, cell).where((F.col("below") + F.col("_u") <= F.col("r")) & (F.col("r") < F.col("below") + F.col("_u") + F.col("n")))
        near = settle(near.select(*keys, "low", "high", "_bin", "r", F.col("_a").alias("_low"), F.col("_b").alias("_high"), F.col("n").alias("size"), (F.col("below") + F.col("_u")).alias("below")))
        chosen = near.select(*cell, "_bin", "_low", "_high").distinct()
        inside = settle(live.join(chosen, [*cell, "_bin"]).select(*keys, "v", F.col("_low").alias("low"), F.col("_high").alias("high")))
        cells = near.select(*keys, F.col("_low").alias("low"), F.col("_high").alias("high"), "size", "r", "below")
    # Few different values are left in a cell: they are counted and ordered.
    few = rows.alias("x").join(found.where("low < high").select(*keys, "low", "high").distinct().alias("c"), list(keys)) if keys else rows.alias("x").join(F.broadcast(found.where("low < high").select("low", "high").distinct().alias("c")))
    few = few.where("v BETWEEN low AND high").groupBy(*keys, "low", "high", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "low", "high").orderBy("v"))
    few = few.withColumn("_upto", upto)
    many = found.where("low < high").join(few, [*keys, "low", "high"]).where((F.col("below") + F.col("_upto") > F.col("r")) & (F.col("below") + F.col("_upto") - F.col("n") <= F.col("r"))).select(*keys, "r", "v")
    values = settle(found.where("low = high").select(*keys, "r", F.col("low").alias("v")).unionByName(many).distinct())
    lower, upper = values.withColumnsRenamed({"r": "_r", "v": "_x"}), values.select(*keys, F.col("r").alias("_t"), F.col("v").alias("_y"))
    out = asked.withColumn("_t", F.least(F.col("_r") + 1, F.col("size") - 1)).join(lower, [*keys, "_r"]).join(upper, [*keys, "_t"])
    return out.select(*keys, "level", (F.col("_x") + (F.col("_y") - F.col("_x")) * F.col("_f")).alias("quantile"))
