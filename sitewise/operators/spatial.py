"""Neighbourhood joins in three dimensions.

Spark has no spatial index, so a ball query becomes an equi-join on cells of a
grid half as wide as the radius: each point of one side looks into the cells
around its own that the ball reaches, and the exact distance decides.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.columns import distance
from .settle import settle

XYZ = ("x", "y", "z")
#: Parts of a crowded cell's centers, so that many tasks share its pairs.
SPREAD = 4
#: Room for rounding, in widths: a cell too many is looked into, and none too few.
SLACK = 1e-9
#: Pairs that a task looks at together, to leave out those too far to count.
RUN = 1 << 18


def _cell(c: Column, side: float) -> Column:
    return F.floor(c / F.lit(side))


def _gap(c: Column, offset: Column, side: float) -> Column:
    """How far ``c`` is from the cell so many places away, at least."""
    lower = (_cell(c, side) + offset) * F.lit(side)
    apart = F.when(offset > 0, lower - c).when(offset < 0, c - lower - F.lit(side)).otherwise(F.lit(0.0))
    return F.greatest(apart - (F.abs(c) + F.lit(side)) * F.lit(SLACK), F.lit(0.0))


def radius_join(centers: DataFrame, points: DataFrame, radius: float, keys: Sequence[str] = (), strict: bool = False, prefix: str = "p_") -> DataFrame:
    """Every center with every point at most ``radius`` away (less, if strict).

    Both sides have x, y and z; ``keys`` must agree too. The points' columns get
    ``prefix``; dist is added. Rows with a null coordinate match nothing.

    The pairs may be far more than the rows, so tasks are dealt by cells and parts
    of cells and not by how many bytes the rows take; a task holds one cell's points.
    """
    side = radius / 2 * (1 + SLACK)
    tasks = max(int(centers.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    steps = (-2, -1, 0, 1, 2)
    around = F.array(*[F.struct(*[F.lit(d).alias(a) for d, a in zip((i, j, k), "abc")]) for i in steps for j in steps for k in steps])
    left = centers.withColumn("_part", F.pmod(F.xxhash64(*XYZ), F.lit(SPREAD)).cast("int")).withColumn("_near", F.explode(around))
    gaps = [_gap(F.col(c), F.col(f"_near.{a}"), side) for c, a in zip(XYZ, "abc")]
    left = left.where(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2] <= radius * radius * (1 + SLACK))
    left = left.select(*centers.columns, "_part", *[(_cell(F.col(c), side) + F.col(f"_near.{a}")).alias(f"_g{c}") for c, a in zip(XYZ, "abc")])
    right = points.select(*[F.col(c).alias(prefix + c) for c in points.columns], *[_cell(F.col(c), side).alias(f"_h{c}") for c in XYZ], F.explode(F.array(*map(F.lit, range(SPREAD)))).alias("_of"))
    left = left.repartition(tasks, *[f"_g{c}" for c in XYZ], "_part", *keys)
    right = right.repartition(tasks, *[f"_h{c}" for c in XYZ], "_of", *[prefix + k for k in keys])
    cond = F.col("_part") == F.col("_of")
    for a, b in [*[(f"_g{c}", f"_h{c}") for c in XYZ], *[(k, prefix + k) for k in keys]]:
        cond = cond & (F.col(a) == F.col(b))
    d = distance(*[(F.col(c), F.col(prefix + c)) for c in XYZ])
    joined = left.join(right, cond).withColumn("dist", d)
    joined = joined.where(F.col("dist") < radius if strict else F.col("dist") <= radius)
    return joined.drop("_part", "_of", *[f"_g{c}" for c in XYZ], *[f"_h{c}" for c in XYZ])


def radius_graph(nodes: DataFrame, radius: float, node: str, env: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """Directed edges src, dst between different nodes of one environment within
    ``radius``, with dist and the unit vector ux, uy, uz from dst to src.

    With ``most``, a node keeps so many nearest neighbours, ties by node; pairs are
    then looked at only as far as a node's nearest may lie.
    """
    own = nodes.select(*env, node, *XYZ)
    if most is None:
        pairs = radius_join(own, own, radius, keys=env).where(F.col(node) != F.col("p_" + node))
    else:
        pairs = _nearest(own, radius, node, env, most)
    units = [F.coalesce(F.try_divide(F.col(c) - F.col("p_" + c), F.col("dist")), F.lit(0.0)).alias("u" + c) for c in XYZ]
    return pairs.select(*env, F.col(node).alias("src"), F.col("p_" + node).alias("dst"), "dist", *units)


def _nearest(own: DataFrame, radius: float, node: str, env: Sequence[str], most: int) -> DataFrame:
    """Each node with its first ``most`` others within the radius, by dist and node.

    Balls begin small, about as large as to hold that many nodes where most nodes
    are, and double: a node that has found enough is asked no more, as all that
    lies farther comes later. Of nodes in one place only the first can be nearest.
    Tasks leave out what can't be before anything is sorted or shuffled.
    """
    known = own.dropna(subset=[*env, *XYZ])
    place = Window.partitionBy(*env, *XYZ).orderBy(node)
    points = settle(known.withColumn("_k", F.dense_rank().over(place)).where(F.col("_k") <= most + 1).drop("_k"))
    r, side = radius, math.inf
    while r < side / 2 and r > radius / (1 << 20):  # cells much wider than the ball say little of its inside
        side = r
        cells = points.groupBy(*env, *[_cell(F.col(c), side).alias(f"_h{c}") for c in XYZ]).agg(F.count("*").alias("_m"))
        reach = F.cbrt(F.lit(1.5 * (most + 1) / math.pi) / F.col("_m")) * side
        r = min(cells.agg(F.percentile(reach, F.lit(0.5), F.col("_m"))).first()[0] or radius, radius)
    left, found = known, None
    while True:
        r = radius if r > radius / 2 else r
        pairs = radius_join(left, points, r, keys=env).where(F.col(node) != F.col("p_" + node))
        pairs = _thinned(pairs, [*env, node], ["dist", "p_" + node], most)
        w = Window.partitionBy(*env, node).orderBy("dist", "p_" + node)
        first = pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
        if r >= radius:
            last = first.drop("_r")
            return last if found is None else found.unionByName(last)
        first = settle(first)
        done = first.where(F.col("_r") == most).select(*env, node)
        got = first.join(done, [*env, node], "left_semi").drop("_r").select(*pairs.columns)
        found = got if found is None else found.unionByName(got)
        left = settle(left.join(done, [*env, node], "left_anti").select(*own.columns))
        if left.isEmpty():
            return found
        r *= 2


def _thinned(pairs: DataFrame, keys: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """Of each run of pairs the first ``most`` of each key: no fewer than its first
    ones overall. A join gives a row's matches in a cell one after the other, so
    what is left grows with the rows and not with the pairs. No nulls in keys."""

    def first(batches: list) -> pa.Table:
        t = pa.Table.from_batches(batches).combine_chunks()
        t = t.take(pc.sort_indices(t, [(c, "ascending") for c in (*keys, *order)]))
        new = np.arange(t.num_rows) == 0
        for c in keys:
            new[1:] |= np.diff(t.column(c).combine_chunks().dictionary_encode().indices.to_numpy()) != 0
        start = np.flatnonzero(new)
        rank = np.arange(t.num_rows) - np.repeat(start, np.diff([*start, t.num_rows]))
        return t.filter(pa.array(rank < most))

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= RUN:
                yield from first(held).to_batches()
                held, size = [], 0
        if size:
            yield from first(held).to_batches()

    return pairs.mapInArrow(run, pairs.schema)


def nearest_point(queries: DataFrame, points: DataFrame, query: str, point: str, radius: float | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """For each query the nearest point, ties by the smaller ``point``.

    With a ``radius`` that is known to reach, the grid join is used; queries
    with nothing inside it are left out. Without one, cells double in width
    until every query has found a point of its keys' group or no group is left.
    """
    best = F.min_by(F.struct(F.col("p_" + point).alias(point), "dist"), F.struct("dist", F.col("p_" + point))).alias("b")
    if radius is not None:
        near = radius_join(queries, points, radius, keys)
        return near.groupBy(query, *keys).agg(best).select(query, *keys, F.col(f"b.{point}").alias(point), "b.dist")
    span = points.agg(*[(F.max(c) - F.min(c)).alias(c) for c in XYZ], F.count("*").alias("n")).first()
    if not span["n"]:
        return queries.limit(0).select(query, *keys, F.lit(None).cast(points.schema[point].dataType).alias(point), F.lit(0.0).alias("dist"))
    widest = max(span["x"] or 0, span["y"] or 0, span["z"] or 0)
    radius = max(widest / max(round(span["n"] ** (1 / 3)), 1), 1e-9)
    left, found = queries, None
    groups = points.select(*keys).distinct() if keys else None
    for _ in range(64):
        got = settle(nearest_point(left, points, query, point, radius, keys))
        found = got if found is None else found.unionByName(got)
        left = left.join(got.select(query, *keys), [query, *keys], "left_anti")
        if groups is not None:
            left = left.join(groups, list(keys), "left_semi")
        left = left.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
        if left.isEmpty():
            return found
        radius *= 4
    return found


def site_neighbors(site_atoms: DataFrame, atoms: DataFrame, radius: float, residue: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Distinct residues of atoms within ``radius`` of any atom of the site."""
    near = radius_join(site_atoms, atoms, radius, keys)
    return near.select(*[F.col("p_" + c).alias(c) for c in residue]).distinct()


def functional_centers(atoms: DataFrame, residue: Sequence[str], resname: str = "resname", name: str = "name", choose: Column | None = None) -> DataFrame:
    """Mean place of each residue's functional atoms, else of its CA; null without either.

    ``residue`` identifies a residue and includes its name. With ``choose``, a
    whole number of the residue, only one of its groups of atoms counts: that of
    the number modulo how many there are.
    """
    groups = F.create_map(*[x for r in tables.STANDARD_RESIDUES for x in (F.lit(r), F.array(*[F.array(*[F.lit(a) for a in g]) for g in tables.key_atoms(r)]))])
    own = F.try_element_at(groups, F.col(resname))
    used = F.flatten(own) if choose is None else F.get(own, F.pmod(choose, F.size(own)).cast("int"))
    is_key = F.coalesce(F.array_contains(used, F.col(name)), F.lit(False))
    means = [F.coalesce(F.avg(F.when(is_key, F.col(c))), F.avg(F.when(F.col(name) == "CA", F.col(c)))).alias(c) for c in XYZ]
    return atoms.groupBy(*residue).agg(*means)


def ca_centers(atoms: DataFrame, residue: Sequence[str], order: str = "atom_idx", name: str = "name") -> DataFrame:
    """Place of each residue's first CA atom; residues without one are left out."""
    first = F.min_by(F.struct(*XYZ), order).alias("c")
    return atoms.where(F.col(name) == "CA").groupBy(*residue).agg(first).select(*residue, "c.x", "c.y", "c.z")


def interface_pairs(left: DataFrame, right: DataFrame, cutoff: float, residue: Sequence[str], distinct: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """Residue pairs of two subunits (of one group of the keys) nearer than
    ``cutoff``, columns suffixed 0 and 1."""
    near = radius_join(left, right, cutoff, keys, strict=True)
    pairs = near.select(*keys, *[F.col(c).alias(c + "0") for c in residue], *[F.col("p_" + c).alias(c + "1") for c in residue])
    return pairs.distinct() if distinct else pairs


def negative_pairs(left: DataFrame, right: DataFrame, positives: DataFrame, residue: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """All residue pairs of two subunits (of one ``within`` group) but the positive ones.

    The result is the product of the two sides by definition; give ``within`` so
    that it is one of subunits and not of tables.
    """
    a = left.select(*within, *[F.col(c).alias(c + "0") for c in residue]).distinct()
    b = right.select(*within, *[F.col(c).alias(c + "1") for c in residue]).distinct()
    both = a.join(b, list(within)) if within else a.crossJoin(b)
    keys = [c + s for s in "01" for c in residue]
    return both.join(positives.select(*keys), keys, "left_anti")


def matching_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, residue: Sequence[str]) -> DataFrame:
    """Pairs whose two residues both exist in the other form of the structure."""
    keep = pairs.join(left.select(*[F.col(c).alias(c + "0") for c in residue]).distinct(), [c + "0" for c in residue], "left_semi")
    return keep.join(right.select(*[F.col(c).alias(c + "1") for c in residue]).distinct(), [c + "1" for c in residue], "left_semi")
