"""Searches: iterative range search from seeds, and annotation of structures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .settle import settle
from .vectors import DIGITS, marked_reach, near_pivots, packed, similarity_join, unit_vectors

#: Bits of a word that searches travel in.
WORD = 63


def iterative_search(db: DataFrame, seeds: DataFrame, cutoffs: DataFrame, iterations: int = 3, group: str = "letter", spread_all: bool = False) -> DataFrame:
    """Rows reached from the seeds within ``iterations`` rounds of range search.

    ``db`` has id, pdb, u and the group; ``seeds`` the same columns; ``cutoffs``
    gives the group's cutoff. A round finds every row whose cosine to a frontier
    row is above its group's cutoff; the rows not found before are the next
    frontier (all hits of the round, if ``spread_all``). One row per hit:
    query, id, cos, iter. An empty frontier ends the search.
    """
    blocks = packed(db, "id", group)  # every round searches the same rows
    frontier = seeds.select("id", "u", group)
    used = seeds.select("id")
    out = None
    for i in range(1, iterations + 1):
        asked = frontier.join(F.broadcast(cutoffs.select(group, "cutoff")), group)
        asked = asked.select(F.col("id").alias("query"), "u", group, "cutoff")
        hits = settle(similarity_join(asked, db, "cutoff", "query", "id", group, blocks=blocks).select("query", "id", "cos").withColumn("iter", F.lit(i)))
        out = hits if out is None else out.unionByName(hits)
        reached = hits.select("id").distinct()
        fresh = settle(reached.join(used, "id", "left_anti"))
        if fresh.isEmpty():
            break
        frontier = db.join(reached if spread_all else fresh, "id", "left_semi").select("id", "u", group)
        used = used.unionAll(fresh)
    return out


def search_grid(db: DataFrame, seeds: DataFrame, cutoffs: dict[float, float], iterations: int = 5) -> tuple[DataFrame, DataFrame]:
    """Searches of many samples at many cutoffs at once: what each reaches, with
    the round that reached it first (sample, p, id, iter), and of each search and
    round that reached anything the number of rows it asked with (sample, p, iter,
    n_query).

    ``seeds`` has sample and id; ``cutoffs`` gives p-values their cosine. All hits
    of a round are the next frontier. A hit is similar to itself, so a frontier
    holds the one before: only what the last round added is asked, and only for
    what a search has not reached. Searches travel as bits of a row, and pairs are
    never written. The samples, few, come to the driver.
    """
    names = [r["sample"] for r in seeds.select("sample").distinct().orderBy("sample").collect()]
    runs = [(s, float(p), float(c)) for s in names for p, c in cutoffs.items()]
    spark, width = db.sparkSession, -(-len(runs) // WORD)
    words = lambda at: [sum(1 << (r % WORD) for r in at if r // WORD == w) for w in range(width)]
    levels = [(c, words([r for r, x in enumerate(runs) if x[2] == c])) for c in sorted(set(map(float, cutoffs.values())))]
    listed = lambda at: F.array(*[F.lit(w).cast("long") for w in words(at)])
    kinds = f"run int, sample {seeds.schema['sample'].dataType.simpleString()}, p double"
    if not runs:
        none = spark.createDataFrame([], kinds).drop("run")
        return none.crossJoin(db.select("id").limit(0)).withColumn("iter", F.lit(1)), none.withColumns({"iter": F.lit(1), "n_query": F.lit(0).cast("long")})
    numbered = spark.createDataFrame([(i, s, p) for i, (s, p, _) in enumerate(runs)], kinds)
    either = lambda df: df.groupBy("id").agg(*[F.bit_or(F.col("marks")[w]).alias(f"w{w}") for w in range(width)]).select("id", F.array(*[f"w{w}" for w in range(width)]).alias("marks"))
    without = lambda a, b: F.zip_with(a, F.coalesce(b, listed([])), lambda x, y: x.bitwiseAND(F.bitwise_not(y)))
    some = F.exists("marks", lambda x: x != 0)
    of_sample = F.coalesce(*[F.when(F.col("sample").eqNullSafe(F.lit(s)), listed([r for r, x in enumerate(runs) if x[0] == s])) for s in names])
    rows = db.select("id", "u")
    start = settle(either(seeds.select("id", of_sample.alias("marks"))))
    fresh, reached, found, pivots = start, None, None, near_pivots(rows)
    for i in range(1, iterations + 1):
        other = F.lit(None).cast("array<long>") if reached is None else F.col("old")
        left = (rows if reached is None else rows.join(reached.withColumnRenamed("marks", "old"), "id", "left")).select("id", "u", without(listed(range(len(runs))), other).alias("marks"))
        new = settle(marked_reach(rows.join(fresh, "id"), left.where(some), levels, pivots=pivots))
        places = F.explode(F.array_compact(F.array(*[F.when(F.col("marks")[r // WORD].bitwiseAND(F.lit(1 << (r % WORD)).cast("long")) != 0, r) for r in range(len(runs))])))
        first = new.select("id", places.alias("run"), F.lit(i).alias("iter"))
        found = first if found is None else found.unionByName(first)
        # What was asked as a seed needs no second time.
        fresh = new if i > 1 else new.join(start.withColumnRenamed("marks", "old"), "id", "left").select("id", without(F.col("marks"), F.col("old")).alias("marks")).where(some)
        reached = new if reached is None else settle(either(reached.unionByName(new)))
        if new.isEmpty():
            break
    sizes = {(r["run"], r["iter"]): r["n"] for r in found.groupBy("run", "iter").agg(F.count("*").alias("n")).collect()}
    given = {r["sample"]: r["n"] for r in seeds.distinct().groupBy("sample").agg(F.count("*").alias("n")).collect()}
    asked = []
    for r, (s, p, _) in enumerate(runs):
        n = given[s]
        for i in range(1, iterations + 1):
            upto = sum(sizes.get((r, k), 0) for k in range(1, i + 1))
            if upto:
                asked.append((s, p, i, n))
            n = upto
    return found.join(F.broadcast(numbered), "run").select("sample", "p", "id", "iter"), spark.createDataFrame(asked, f"{kinds.split(', ', 1)[1]}, iter int, n_query long")


def grid_metrics(found: DataFrame, rounds: DataFrame, truth: DataFrame) -> DataFrame:
    """Of each search and round (the results of ``search_grid``), over the ids found
    so far: recall, recall of TP, shares of the structures with a FN or FP that
    were hit, precision, n_query.

    A structure is hit if any of its rows is found. Shares without a denominator
    are null. Counts are taken by the first round and added up.
    """
    pdbs = truth.groupBy("pdb").agg(F.max((F.col("label") == "FN").cast("int")).alias("has_fn"), F.max((F.col("label") == "FP").cast("int")).alias("has_fp"))
    pos = F.col("label").isin("TP", "FN")
    sizes = truth.agg(F.count(F.when(pos, 1)).alias("n_pos"), F.count(F.when(F.col("label") == "TP", 1)).alias("n_tp")).join(F.broadcast(pdbs.agg(F.sum("has_fn").alias("n_fn"), F.sum("has_fp").alias("n_fp"))))
    # A structure's rows of one search and round at once.
    parts = found.join(truth, "id").groupBy("sample", "p", "pdb", "iter").agg(F.count("*").alias("n_found"), F.count(F.when(pos, 1)).alias("hit_pos"), F.count(F.when(F.col("label") == "TP", 1)).alias("hit_tp"))
    first = F.min("iter").over(Window.partitionBy("sample", "p", "pdb")) == F.col("iter")
    parts = parts.withColumn("new", first.cast("int")).join(pdbs, "pdb")
    counts = parts.groupBy("sample", "p", F.col("iter").alias("first")).agg(*[F.sum(c).alias(c) for c in ("n_found", "hit_pos", "hit_tp")], *[F.sum(F.col("new") * F.col(f"has_{c}")).alias(f"hit_{c}") for c in ("fn", "fp")])
    got = rounds.join(counts, ["sample", "p"]).where("first <= iter").groupBy("sample", "p", "iter", "n_query").agg(*[F.sum(c).alias(c) for c in ("n_found", "hit_pos", "hit_tp", "hit_fn", "hit_fp")])
    r = got.join(F.broadcast(sizes))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return r.select("sample", "p", "iter", "n_query", "n_found", share("hit_pos", "n_pos").alias("recall"), share("hit_tp", "n_tp").alias("tp_recall"), share("hit_fn", "n_fn").alias("fn_recall"), share("hit_fp", "n_fp").alias("fp_rate"), share("hit_pos", "n_found").alias("precision"))


def first_hits(hits: DataFrame, key: str, order: Sequence) -> DataFrame:
    """The first hit of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def search_metrics(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Recall, recall by class and precision of each iteration's accumulated ids.

    ``results`` has iter, id (found up to that iteration); ``truth`` has id, pdb
    and label, one of TP, FN, FP, TN. Shares without a denominator are null.
    """
    sizes = truth.agg(
        F.count(F.when(F.col("label").isin("TP", "FN"), 1)).alias("n_pos"), F.count(F.when(F.col("label") == "TP", 1)).alias("n_tp"),
        F.countDistinct(F.when(F.col("label") == "FN", F.col("pdb"))).alias("n_fn_pdb"), F.countDistinct(F.when(F.col("label") == "FP", F.col("pdb"))).alias("n_fp_pdb"),
    )
    got = results.select("iter", "id").distinct().join(truth, "id").groupBy("iter").agg(
        F.count("*").alias("n_found"), F.count(F.when(F.col("label").isin("TP", "FN"), 1)).alias("hit_pos"), F.count(F.when(F.col("label") == "TP", 1)).alias("hit_tp"),
        F.countDistinct(F.when(F.col("label") == "FN", F.col("pdb"))).alias("hit_fn"), F.countDistinct(F.when(F.col("label") == "FP", F.col("pdb"))).alias("hit_fp"),
    )
    r = got.join(F.broadcast(sizes))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return r.select("iter", "n_found", share("hit_pos", "n_pos").alias("recall"), share("hit_tp", "n_tp").alias("tp_recall"), share("hit_fn", "n_fn_pdb").alias("fn_recall"), share("hit_fp", "n_fp_pdb").alias("fp_rate"), share("hit_pos", "n_found").alias("precision"))


def annotate(residues: DataFrame, sites: DataFrame, cutoff: float, structure: str | None = None) -> DataFrame:
    """Residues similar to a site above the global and the site's own cutoff.

    ``residues`` has res_id, pdb, chain_resid and u; ``sites`` has site_id, pdb,
    resid, site, source, u and site_cutoff. A site of the residue's own
    structure (first four characters of pdb, or the column ``structure`` of both
    sides) does not count. One row per site, source, structure and residue: n_hits
    (distinct "pdb: resid"), n_pdbs, evidence.
    """
    # The rows travel through the join as its ids, so that pairs, as many as a share of
    # the product, meet no table again; those below a site's cutoff are not written.
    whole = (F.substring("pdb", 1, 4) if structure is None else F.col(structure)).alias("whole")
    r = residues.select(F.struct("res_id", F.col("pdb").alias("query_pdb"), "chain_resid", whole).alias("_res"), "u")
    s = sites.where(F.col("site_cutoff").isNotNull()).select(F.struct("site_id", "pdb", "resid", "site", "source", whole).alias("_site"), "u", F.greatest(F.lit(float(cutoff)), "site_cutoff").alias("_least"))
    pairs = similarity_join(s, r, "_least", "_site", "_res").where(F.col("_res.whole") != F.col("_site.whole"))
    hit = F.struct("_site.pdb", F.concat_ws(": ", "_site.pdb", "_site.resid").alias("evidence"))
    found = pairs.groupBy("_res.query_pdb", "_site.site", "_site.source", "_res.chain_resid").agg(F.collect_set(hit).alias("hits"))
    evidence, pdbs = F.array_distinct("hits.evidence"), F.array_distinct(F.array_compact("hits.pdb"))
    return found.select("query_pdb", "site", "source", "chain_resid", F.size(evidence).cast("long").alias("n_hits"), F.size(pdbs).cast("long").alias("n_pdbs"), F.sort_array(evidence).alias("evidence"))


__all__ = ["annotate", "first_hits", "grid_metrics", "iterative_search", "search_grid", "search_metrics", "unit_vectors"]
