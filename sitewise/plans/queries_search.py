"""Queries of similarity search, calibration and annotation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import calibrate, metrics, ranks, sampling, search, vectors
from ..operators.pair_scores import PairScores, top_statistics
from ..operators.settle import settle
from ..registry import query
from .standins import DB_SQL, site_db, table

COS = "list_cosine_similarity({}, {})"
#: All unordered pairs of one label with their cosine.
PAIRS_SQL = f"""{DB_SQL}, pairs AS (
    SELECT a.letter, a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS cos
    FROM db a JOIN db b ON a.letter = b.letter AND a.id < b.id
)"""
LEVELS = (0.01, 0.005, 0.001, 0.0001)


def _label_pairs(spark, sf_dir):
    return vectors.similar_pairs(site_db(spark, sf_dir), -2.0, "id", "letter")


@query("unit_normalize", f"""WITH {DB_SQL}
    SELECT id, CAST(t.i - 1 AS INTEGER) AS dim, round(e[t.i] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS u
    FROM db, range(1, 65) t(i)""")
def unit_normalize(spark, sf_dir):
    return site_db(spark, sf_dir).select("id", F.posexplode("u").alias("dim", "u")).withColumn("u", F.round("u", 6))


@query("cosine_pairs", f"""WITH {DB_SQL}
    SELECT a.id AS a, b.id AS b, round({COS.format('a.e', 'b.e')}, 6) AS cos FROM db a JOIN db b ON a.id < b.id
    WHERE round({COS.format('a.e', 'b.e')}, 9) > 0.35""")
def cosine_pairs(spark, sf_dir):
    return vectors.similar_pairs(site_db(spark, sf_dir), 0.35, "id").select("a", "b", F.round("cos", 6).alias("cos"))


@query("cosine_range_search", f"""WITH {DB_SQL}
    SELECT q.id AS query, d.id AS id, round({COS.format('q.e', 'd.e')}, 6) AS cos FROM db q JOIN db d ON q.letter = d.letter
    WHERE q.id % 50 = 0 AND round({COS.format('q.e', 'd.e')}, 9) > 0.2""")
def cosine_range_search(spark, sf_dir):
    db = site_db(spark, sf_dir)
    q = db.where("id % 50 = 0").withColumnRenamed("id", "query")
    return vectors.similarity_join(q, db, 0.2, "query", "id", "letter").select("query", "id", F.round("cos", 6).alias("cos"))


@query("knn_vote", f"""WITH {DB_SQL}, near AS (
        SELECT q.id, q.letter AS truth, d.letter AS vote, row_number() OVER (PARTITION BY q.id ORDER BY round({COS.format('q.e', 'd.e')}, 9) DESC, d.id) AS r
        FROM db q JOIN db d ON q.id % 4 <> d.id % 4
    ), votes AS (SELECT id, truth, vote, count(*) AS n FROM near WHERE r <= 5 GROUP BY ALL)
    SELECT id, truth, arg_min(vote, -n * 1000 + vote) AS predicted FROM votes GROUP BY id, truth""")
def knn_vote(spark, sf_dir):
    return vectors.nearest_vote(site_db(spark, sf_dir), "id", "letter", k=5, folds=4)


@query("knn_accuracy", f"""WITH {DB_SQL}, near AS (
        SELECT q.id, q.letter AS truth, d.letter AS vote, row_number() OVER (PARTITION BY q.id ORDER BY round({COS.format('q.e', 'd.e')}, 9) DESC, d.id) AS r
        FROM db q JOIN db d ON q.id % 4 <> d.id % 4
    ), votes AS (SELECT id, truth, vote, count(*) AS n FROM near WHERE r <= 5 GROUP BY ALL
    ), p AS (SELECT id, truth, arg_min(vote, -n * 1000 + vote) AS predicted FROM votes GROUP BY id, truth)
    SELECT CAST(id % 4 AS INTEGER) AS fold, round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY 1""")
def knn_accuracy(spark, sf_dir):
    p = vectors.nearest_vote(site_db(spark, sf_dir), "id", "letter", k=5, folds=4)
    return p.groupBy((F.col("id") % 4).cast("int").alias("fold")).agg(F.round(F.avg((F.col("truth") == F.col("predicted")).cast("double")), 6).alias("accuracy"))


@query("background_quantiles", f"""WITH {PAIRS_SQL}, p AS (SELECT unnest([{', '.join(map(str, LEVELS))}]) AS p)
    SELECT letter, CAST(p.p AS DOUBLE) AS p, round(quantile_cont(cos, 0.99), 6) AS cutoff FROM pairs, p WHERE p.p = 0.01 GROUP BY letter, p.p
    UNION ALL SELECT letter, CAST(0.005 AS DOUBLE), round(quantile_cont(cos, 0.995), 6) FROM pairs GROUP BY letter
    UNION ALL SELECT letter, CAST(0.001 AS DOUBLE), round(quantile_cont(cos, 0.999), 6) FROM pairs GROUP BY letter
    UNION ALL SELECT letter, CAST(0.0001 AS DOUBLE), round(quantile_cont(cos, 0.9999), 6) FROM pairs GROUP BY letter
    UNION ALL SELECT NULL, CAST(0.01 AS DOUBLE), round(quantile_cont(cos, 0.99), 6) FROM pairs
    UNION ALL SELECT NULL, CAST(0.005 AS DOUBLE), round(quantile_cont(cos, 0.995), 6) FROM pairs
    UNION ALL SELECT NULL, CAST(0.001 AS DOUBLE), round(quantile_cont(cos, 0.999), 6) FROM pairs
    UNION ALL SELECT NULL, CAST(0.0001 AS DOUBLE), round(quantile_cont(cos, 0.9999), 6) FROM pairs""")
def background_quantiles(spark, sf_dir):
    q = calibrate.pair_cutoffs(PairScores(site_db(spark, sf_dir), "id", "letter"), LEVELS, combined=True)
    return q.withColumn("cutoff", F.round("cutoff", 6))


@query("background_moments", f"""WITH {PAIRS_SQL}
    SELECT letter, round(avg(cos), 6) AS mean, round(stddev_pop(cos), 6) AS std, count(*) AS n FROM pairs GROUP BY GROUPING SETS ((letter), ())""")
def background_moments(spark, sf_dir):
    m = calibrate.moments(_label_pairs(spark, sf_dir), ["letter"], combined=True)
    return m.select("letter", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


DRAWN_SQL = f"""{DB_SQL}, p AS (
        SELECT id, letter, e, row_number() OVER (PARTITION BY letter ORDER BY id) - 1 AS rn, count(*) OVER (PARTITION BY letter) AS n, min(id) OVER (PARTITION BY letter) AS k FROM db
    ), g AS (SELECT DISTINCT letter, n, k FROM p WHERE n > 1), d AS (
        SELECT letter, n, t.i AS draw, ((((k * 3000 + t.i) * 48271 + 11) % 2147483647) * 69621 + 1) % 2147483647 % n AS i,
               ((((k * 3000 + t.i) * 48271 + 7930) % 2147483647) * 69621 + 1) % 2147483647 % (n - 1) AS j
        FROM g, range(3000) t(i)
    ), drawn AS (
        SELECT d.letter, list_cosine_similarity(a.e, b.e) AS cos
        FROM d JOIN p a ON a.letter = d.letter AND a.rn = d.i JOIN p b ON b.letter = d.letter AND b.rn = CASE WHEN d.j >= d.i THEN d.j + 1 ELSE d.j END
    )"""
GRID_SQL = f"grid AS (SELECT unnest({list(map(float, calibrate.P_VALUES))}::DOUBLE[]) AS p, unnest(range(1, {len(calibrate.P_VALUES) + 1})) AS i)"
GRID_LEVELS = [1 - p for p in calibrate.P_VALUES]


@query("build_background", f"""WITH {DRAWN_SQL}, {GRID_SQL}, q AS (
        SELECT letter, quantile_cont(cos, {GRID_LEVELS}) AS q, avg(cos) AS mean, stddev_pop(cos) AS std, count(*) AS n FROM drawn GROUP BY GROUPING SETS ((letter), ())
    ) SELECT letter, p, round(q[i], 6) AS cutoff, round(mean, 6) AS mean, round(std, 6) AS std, n FROM q, grid""")
def build_background(spark, sf_dir):
    """The background of sampled pairs: every quantile of the grid, by type and for all."""
    from .pipelines import build_background as build

    cutoffs, moments = build(site_db(spark, sf_dir), draws=3000)
    m = moments.withColumnRenamed("letter", "l")
    both = cutoffs.join(m, F.col("letter").eqNullSafe(F.col("l")))
    return both.select("letter", "p", *[F.round(c, 6).alias(c) for c in ("cutoff", "mean", "std")], "n")


SITE_BG_SQL = f"""{DB_SQL}, s AS (
    SELECT s.id AS site_id, list_cosine_similarity(s.e, b.e) AS cos FROM db s JOIN db b ON s.letter = b.letter WHERE s.id % 3 = 0 AND b.id % 3 <> 0
)"""


@query("site_background", f"""WITH {SITE_BG_SQL}
    SELECT site_id, round(avg(cos), 6) AS mean_cos, round(stddev_pop(cos), 6) AS std_cos, round(quantile_cont(cos, 0.99), 6) AS q99, round(quantile_cont(cos, 0.999), 6) AS q999 FROM s GROUP BY site_id""")
def site_background(spark, sf_dir):
    db = site_db(spark, sf_dir)
    found = top_statistics(db.where("id % 3 = 0").withColumnRenamed("id", "site_id"), db.where("id % 3 <> 0"), "site_id", "id", "letter", [0.99, 0.999])
    r = lambda c, name: F.round(c, 6).alias(name)
    return found.select("site_id", r("mean", "mean_cos"), r("std", "std_cos"), *[r(F.col("quantiles")[i]["quantile"], q) for i, q in enumerate(("q99", "q999"))])


@query("build_site_db", f"""WITH {SITE_BG_SQL}, {GRID_SQL}, q AS (SELECT site_id, quantile_cont(cos, {GRID_LEVELS}) AS q, avg(cos) AS mean, stddev_pop(cos) AS std FROM s GROUP BY site_id)
    SELECT site_id, letter, round(mean, 6) AS mean_cos, round(std, 6) AS std_cos, p, round(q.q[i], 6) AS cutoff FROM q JOIN db ON db.id = q.site_id, grid""")
def build_site_db(spark, sf_dir):
    """Every site with its own cutoffs over the whole grid."""
    from .pipelines import build_site_db as build

    db = site_db(spark, sf_dir)
    built = build(db.where("id % 3 = 0").withColumnRenamed("id", "site_id"), db.where("id % 3 <> 0"))
    flat = built.select("site_id", "letter", "mean_cos", "std_cos", F.explode("quantiles").alias("q"))
    return flat.select("site_id", "letter", *[F.round(c, 6).alias(c) for c in ("mean_cos", "std_cos")], "q.p", F.round("q.cutoff", 6).alias("cutoff"))


def _round(i: int) -> str:
    return f"""h{i} AS (
        SELECT f.id AS query, d.id, list_cosine_similarity(f.e, d.e) AS cos, CAST({i} AS INTEGER) AS iter
        FROM f{i - 1} f JOIN db d ON f.letter = d.letter JOIN cut c ON c.letter = f.letter
        WHERE round(list_cosine_similarity(f.e, d.e), 9) > round(c.cutoff, 9)
    ), f{i} AS (SELECT * FROM db WHERE id IN (SELECT id FROM h{i}) AND id NOT IN (SELECT id FROM u{i - 1})
    ), u{i} AS (SELECT id FROM u{i - 1} UNION SELECT id FROM f{i})"""


SEARCH_SQL = f"""{PAIRS_SQL}, cut AS (SELECT letter, quantile_cont(cos, 0.99) AS cutoff FROM pairs GROUP BY letter
    ), f0 AS (SELECT * FROM db WHERE id = 7), u0 AS (SELECT id FROM f0),
    {_round(1)}, {_round(2)}, {_round(3)},
    hits AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)"""


def _hits(spark, sf_dir, iterations=3):
    db = site_db(spark, sf_dir)
    pairs = PairScores(db, "id", "letter")
    cutoffs = calibrate.pair_cutoffs(pairs, [0.01])
    return search.iterative_search(db, db.where("id = 7"), cutoffs, iterations), db, pairs


@query("iterative_site_search", f"""WITH {SEARCH_SQL}, best AS (
        SELECT h.*, d.pdb, row_number() OVER (PARTITION BY d.pdb ORDER BY iter, query, h.id) AS r FROM hits h JOIN db d ON h.id = d.id
    ), one AS (SELECT * FROM best WHERE r = 1)
    SELECT o.pdb, o.id, o.query, o.iter, round(o.cos, 6) AS cosine,
           round((SELECT count(*) FROM pairs p WHERE round(p.cos, 9) < round(o.cos, 9)) / CAST((SELECT count(*) FROM pairs) AS DOUBLE), 4) AS percentile, n.n_name AS description
    FROM one o LEFT JOIN nation n ON n.n_nationkey = o.pdb % 30""")
def iterative_site_search(spark, sf_dir):
    """Seed, search rounds, first hit by structure, percentile, metadata."""
    hits, db, pairs = _hits(spark, sf_dir)
    one = search.first_hits(hits.join(db.select("id", "pdb"), "id"), "pdb", ["iter", "query", "id"])
    scored = pairs.share_below(settle(one), "cos", "percentile")
    meta = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("description"))
    out = scored.join(meta, (F.col("pdb") % 30) == F.col("k"), "left")
    return out.select("pdb", "id", "query", "iter", F.round("cos", 6).alias("cosine"), F.round("percentile", 4).alias("percentile"), "description")


@query("search_hits_by_iteration", f"""WITH {SEARCH_SQL} SELECT iter, query, id, round(cos, 6) AS cos FROM hits""")
def search_hits_by_iteration(spark, sf_dir):
    return _hits(spark, sf_dir)[0].select("iter", "query", "id", F.round("cos", 6).alias("cos"))


LABEL_SQL = "CASE WHEN letter = (SELECT letter FROM db WHERE id = 7) THEN CASE WHEN id % 3 = 0 THEN 'FN' ELSE 'TP' END ELSE CASE WHEN id % 3 = 0 THEN 'FP' ELSE 'TN' END END"


def _spread(i: int) -> str:
    return f"""g{i} AS (
        SELECT DISTINCT d.id FROM {'f0' if i == 1 else f'g{i - 1}x'} f JOIN db d ON round(list_cosine_similarity(f.e, d.e), 9) > 0.33
    ), g{i}x AS (SELECT * FROM db WHERE id IN (SELECT id FROM g{i}))"""


@query("search_metrics", f"""WITH {DB_SQL}, f0 AS (SELECT * FROM db WHERE id IN (7, 17)), truth AS (SELECT id, pdb, {LABEL_SQL} AS label FROM db),
    {_spread(1)}, {_spread(2)}, {_spread(3)},
    found AS (SELECT 1 AS iter, id FROM g1 UNION SELECT 2, id FROM g1 UNION SELECT 2, id FROM g2 UNION SELECT 3, id FROM g1 UNION SELECT 3, id FROM g2 UNION SELECT 3, id FROM g3),
    t AS (SELECT f.iter, f.id, tr.pdb, tr.label FROM found f JOIN truth tr ON f.id = tr.id)
    SELECT CAST(iter AS INTEGER) AS iter, count(*) AS n_found,
      round(count(*) FILTER (label IN ('TP', 'FN')) / CAST((SELECT count(*) FROM truth WHERE label IN ('TP', 'FN')) AS DOUBLE), 6) AS recall,
      round(count(*) FILTER (label = 'TP') / CAST((SELECT count(*) FROM truth WHERE label = 'TP') AS DOUBLE), 6) AS tp_recall,
      round(count(DISTINCT pdb) FILTER (label = 'FN') / CAST((SELECT count(DISTINCT pdb) FROM truth WHERE label = 'FN') AS DOUBLE), 6) AS fn_recall,
      round(count(DISTINCT pdb) FILTER (label = 'FP') / CAST((SELECT count(DISTINCT pdb) FROM truth WHERE label = 'FP') AS DOUBLE), 6) AS fp_rate,
      round(count(*) FILTER (label IN ('TP', 'FN')) / CAST(count(*) AS DOUBLE), 6) AS precision
    FROM t GROUP BY iter""")
def search_metrics(spark, sf_dir):
    """All hits of a round are the next frontier; ids add up over rounds."""
    db = site_db(spark, sf_dir).withColumn("one", F.lit(1))
    cut = spark.createDataFrame([(1, 0.33)], "one int, cutoff double")
    hits = search.iterative_search(db, db.where("id IN (7, 17)"), cut, 3, group="one", spread_all=True)
    seen = hits.groupBy("id").agg(F.min("iter").alias("first"))
    rounds = spark.range(1, 4).select(F.col("id").cast("int").alias("iter"))
    found = seen.join(F.broadcast(rounds), F.col("iter") >= F.col("first")).select("iter", "id")
    same = F.col("letter") == db.where("id = 7").select("letter").first()["letter"]
    third = F.col("id") % 3 == 0
    truth = db.select("id", "pdb", F.when(same, F.when(third, "FN").otherwise("TP")).otherwise(F.when(third, "FP").otherwise("TN")).alias("label"))
    m = search.search_metrics(found, truth)
    return m.select("iter", "n_found", *[F.round(c, 6).alias(c) for c in ("recall", "tp_recall", "fn_recall", "fp_rate", "precision")])


#: Cosines that stand for the p-values of a background.
GRID_CUTOFFS = {0.005: 0.28, 0.001: 0.32, 0.0005: 0.36, 0.0001: 0.40, 0.00001: 0.45}


def _grid_round(i: int) -> str:
    return f"""h{i} AS MATERIALIZED (SELECT DISTINCT f.sample, f.p, f.cutoff, c.id FROM h{i - 1} f JOIN near c ON c.query = f.id AND c.cos > f.cutoff),
    s{i} AS (SELECT sample, p, {i} AS iter, count(*) AS n_query FROM h{i - 1} GROUP BY sample, p)"""


@query("search_grid", f"""WITH {DB_SQL}, near AS MATERIALIZED (
        SELECT a.id AS query, b.id, round(list_cosine_similarity(a.e, b.e), 9) AS cos FROM db a JOIN db b ON round(list_cosine_similarity(a.e, b.e), 9) > {min(GRID_CUTOFFS.values())}
    ), f0 AS (SELECT * FROM db WHERE id = 7), truth AS (SELECT id, pdb, {LABEL_SQL} AS label FROM db),
    marked AS (SELECT t.*, max(CASE WHEN label = 'FN' THEN 1 ELSE 0 END) OVER (PARTITION BY pdb) AS has_fn, max(CASE WHEN label = 'FP' THEN 1 ELSE 0 END) OVER (PARTITION BY pdb) AS has_fp FROM truth t),
    r AS (SELECT s.i AS sample, id, row_number() OVER (PARTITION BY s.i ORDER BY ((id * 48271 + (s.i * 7919 + 11)) % 2147483647 * 69621 + 1) % 2147483647, id) AS k FROM truth, range(10) s(i) WHERE label = 'TP'),
    g AS (SELECT unnest({list(GRID_CUTOFFS)}::DOUBLE[]) AS p, unnest({list(GRID_CUTOFFS.values())}::DOUBLE[]) AS cutoff),
    h0 AS (SELECT sample, p, cutoff, id FROM r, g WHERE k <= 3), {', '.join(_grid_round(i) for i in range(1, 6))},
    found AS (SELECT sample, p, 1 AS iter, id FROM h1 UNION SELECT sample, p, 2, id FROM h2 UNION SELECT sample, p, 3, id FROM h3 UNION SELECT sample, p, 4, id FROM h4 UNION SELECT sample, p, 5, id FROM h5),
    asked AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4 UNION ALL SELECT * FROM s5),
    so_far AS (SELECT DISTINCT a.sample, a.p, a.iter, a.n_query, f.id FROM asked a JOIN found f ON f.sample = a.sample AND f.p = a.p AND f.iter <= a.iter),
    t AS (SELECT s.*, m.pdb, m.label, m.has_fn, m.has_fp FROM so_far s JOIN marked m ON m.id = s.id)
    SELECT CAST(sample AS INTEGER) AS sample, p, CAST(iter AS INTEGER) AS iter, n_query, count(*) AS n_found,
      round(count(*) FILTER (label IN ('TP', 'FN')) / CAST((SELECT count(*) FROM truth WHERE label IN ('TP', 'FN')) AS DOUBLE), 6) AS recall,
      round(count(*) FILTER (label = 'TP') / CAST((SELECT count(*) FROM truth WHERE label = 'TP') AS DOUBLE), 6) AS tp_recall,
      round(count(DISTINCT pdb) FILTER (has_fn = 1) / CAST((SELECT count(DISTINCT pdb) FROM truth WHERE label = 'FN') AS DOUBLE), 6) AS fn_recall,
      round(count(DISTINCT pdb) FILTER (has_fp = 1) / CAST((SELECT count(DISTINCT pdb) FROM truth WHERE label = 'FP') AS DOUBLE), 6) AS fp_rate,
      round(count(*) FILTER (label IN ('TP', 'FN')) / CAST(count(*) AS DOUBLE), 6) AS precision
    FROM t GROUP BY sample, p, iter, n_query""")
def search_grid(spark, sf_dir):
    """Ten samples of three seeds at five cutoffs, five rounds: five passes."""
    db = site_db(spark, sf_dir)
    same = F.col("letter") == db.where("id = 7").select("letter").first()["letter"]
    third = F.col("id") % 3 == 0
    truth = db.select("id", "pdb", F.when(same, F.when(third, "FN").otherwise("TP")).otherwise(F.when(third, "FP").otherwise("TN")).alias("label"))
    each = truth.where("label = 'TP'").select("id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("sample"))
    order = Window.partitionBy("sample").orderBy(sampling.mixed(F.col("id"), F.col("sample")), "id")
    seeds = each.withColumn("k", F.row_number().over(order)).where("k <= 3").select("sample", "id")
    m = search.grid_metrics(*search.search_grid(db, seeds, GRID_CUTOFFS, 5), truth)
    return m.select("sample", "p", "iter", "n_query", "n_found", *[F.round(c, 6).alias(c) for c in ("recall", "tp_recall", "fn_recall", "fp_rate", "precision")])


@query("annotate_sites", f"""WITH {SITE_BG_SQL}, own AS (SELECT site_id, quantile_cont(cos, 0.98) AS site_cutoff FROM s GROUP BY site_id),
    sites AS (SELECT d.*, o.site_cutoff, d.id % 2 AS source FROM db d JOIN own o ON d.id = o.site_id),
    pairs AS (
        SELECT r.pdb AS query_pdb, s.letter AS site, s.source, r.letter || '_' || r.id AS chain_resid, lpad(CAST(s.pdb AS VARCHAR), 4, '0') AS pdb, CAST(s.id AS VARCHAR) AS resid
        FROM db r JOIN sites s ON round(list_cosine_similarity(r.e, s.e), 9) > 0.15 AND round(list_cosine_similarity(r.e, s.e), 9) > round(s.site_cutoff, 9)
        WHERE r.id % 3 <> 0 AND r.pdb <> s.pdb
    )
    SELECT lpad(CAST(query_pdb AS VARCHAR), 4, '0') AS query_pdb, CAST(site AS VARCHAR) AS site, CAST(source AS VARCHAR) AS source, chain_resid,
           count(DISTINCT pdb || ': ' || resid) AS n_hits, count(DISTINCT pdb) AS n_pdbs, string_agg(DISTINCT pdb || ': ' || resid, ', ' ORDER BY pdb || ': ' || resid) AS evidence
    FROM pairs GROUP BY ALL""")
def annotate_sites(spark, sf_dir):
    db = site_db(spark, sf_dir).withColumn("code", F.lpad(F.col("pdb").cast("string"), 4, "0"))
    cosines = db.where("id % 3 = 0").withColumnRenamed("id", "site_id"), db.where("id % 3 <> 0")
    own = top_statistics(*cosines, "site_id", "id", "letter", [0.98]).select("site_id", F.col("quantiles")[0]["quantile"].alias("site_cutoff"))
    sites = db.select(F.col("id").alias("site_id"), F.col("code").alias("pdb"), F.col("id").cast("string").alias("resid"), F.col("letter").cast("string").alias("site"), (F.col("id") % 2).cast("string").alias("source"), F.col("pdb").alias("structure"), "u").join(own, "site_id")
    residues = db.where("id % 3 <> 0").select(F.col("id").alias("res_id"), F.col("code").alias("pdb"), F.concat_ws("_", F.col("letter").cast("string"), F.col("id").cast("string")).alias("chain_resid"), F.col("pdb").alias("structure"), "u")
    # Codes have four characters; structures are told apart by their whole number.
    return search.annotate(residues, sites, 0.15, "structure").withColumn("evidence", F.array_join("evidence", ", "))


@query("ecdf_percentile", """WITH s AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS score FROM documents), b AS (SELECT CAST(l_quantity * 60 AS DOUBLE) AS v FROM lineitem)
    SELECT s.doc_id, round((SELECT count(*) FROM b WHERE b.v < s.score) / CAST((SELECT count(*) FROM b) AS DOUBLE), 6) AS percentile FROM s""")
def ecdf_percentile(spark, sf_dir):
    scores = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    background = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 60).alias("v"))
    return calibrate.percentile_scores(scores, background, "score", "v").select("doc_id", F.round("percentile", 6).alias("percentile"))


@query("metadata_join", f"""WITH {DB_SQL} SELECT db.id, db.pdb, s.s_name AS description FROM db LEFT JOIN supplier s ON s.s_suppkey = db.pdb""")
def metadata_join(spark, sf_dir):
    meta = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pdb"), F.col("s_name").alias("description"))
    return site_db(spark, sf_dir).join(meta, "pdb", "left").select("id", "pdb", "description")


@query("same_letter_prefilter", f"WITH {DB_SQL} SELECT id, letter FROM db WHERE letter = 3")
def same_letter_prefilter(spark, sf_dir):
    return site_db(spark, sf_dir).where("letter = 3").select("id", "letter")


@query("self_exclusion", f"WITH {DB_SQL} SELECT id, pdb FROM db WHERE substr(lpad(CAST(pdb AS VARCHAR), 4, '0'), 1, 4) NOT IN (SELECT substr(lpad(CAST(pdb AS VARCHAR), 4, '0'), 1, 4) FROM db WHERE id % 150 = 0)")
def self_exclusion(spark, sf_dir):
    from ..operators.filters import without_self

    db = site_db(spark, sf_dir).withColumn("code", F.lpad(F.col("pdb").cast("string"), 4, "0"))
    return without_self(db, db.where("id % 150 = 0"), "code", "code").select("id", "pdb")


@query("background_pair_sample", f"""WITH {DB_SQL}, p AS (
        SELECT id, letter, row_number() OVER (PARTITION BY letter ORDER BY id) - 1 AS rn, count(*) OVER (PARTITION BY letter) AS n, min(id) OVER (PARTITION BY letter) AS k FROM db
    ), g AS (SELECT DISTINCT letter, n, k FROM p WHERE n > 1), d AS (
        SELECT letter, n, t.i AS draw, ((((k * 200 + t.i) * 48271 + 11) % 2147483647) * 69621 + 1) % 2147483647 % n AS i,
               ((((k * 200 + t.i) * 48271 + 7930) % 2147483647) * 69621 + 1) % 2147483647 % (n - 1) AS j
        FROM g, range(200) t(i)
    ), e AS (SELECT letter, draw, i, CASE WHEN j >= i THEN j + 1 ELSE j END AS j FROM d)
    SELECT e.letter, CAST(e.draw AS INTEGER) AS draw, a.id AS a, b.id AS b FROM e JOIN p a ON a.letter = e.letter AND a.rn = e.i JOIN p b ON b.letter = e.letter AND b.rn = e.j""")
def background_pair_sample(spark, sf_dir):
    return sampling.random_pairs(site_db(spark, sf_dir), 200, "id", "letter")


@query("minmax_scale", f"""WITH {DB_SQL}, l AS (SELECT id, t.i AS d, e[t.i] AS x FROM db, range(1, 65) t(i)), m AS (SELECT d, min(x) AS a, max(x) AS b FROM l GROUP BY d)
    SELECT l.id, CAST(l.d - 1 AS INTEGER) AS dim, round((x - a) / (b - a), 6) AS scaled FROM l JOIN m ON l.d = m.d""")
def minmax_scale(spark, sf_dir):
    long = site_db(spark, sf_dir).select("id", F.posexplode("e").alias("dim", "x"))
    span = long.groupBy("dim").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return long.join(F.broadcast(span), "dim").select("id", "dim", F.round(F.try_divide(F.col("x") - F.col("a"), F.col("b") - F.col("a")), 6).alias("scaled"))


@query("pair_confidence", f"""WITH {DB_SQL} SELECT a.id AS a, b.id AS b, round({COS.format('a.e', 'b.e')}, 6) AS cos, round((a.id % 100 + b.id % 100) / 2.0, 6) AS confidence
    FROM db a JOIN db b ON a.id < b.id AND a.letter = b.letter WHERE round({COS.format('a.e', 'b.e')}, 9) > 0.25""")
def pair_confidence(spark, sf_dir):
    db = site_db(spark, sf_dir)
    pairs = vectors.similar_pairs(db, 0.25, "id", "letter")
    return pairs.select("a", "b", F.round("cos", 6).alias("cos"), F.round((F.col("a") % 100 + F.col("b") % 100) / 2.0, 6).alias("confidence"))


@query("embedding_std", f"""WITH {DB_SQL}, l AS (SELECT t.i AS d, e[t.i] / sqrt(list_sum(list_transform(e, lambda x: x * x))) AS x FROM db, range(1, 65) t(i)), s AS (SELECT d, stddev_samp(x) AS s FROM l GROUP BY d)
    SELECT round(avg(s), 6) AS mean_std, count(*) AS n_dims FROM s""")
def embedding_std(spark, sf_dir):
    dims = vectors.per_dimension(site_db(spark, sf_dir), [], F.col("u"), s=F.stddev_samp)
    return dims.agg(F.round(F.avg("s"), 6).alias("mean_std"), F.count("*").alias("n_dims"))


@query("pos_neg_cosine", f"""WITH {DB_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS rn, row_number() OVER (ORDER BY ((id * 48271 + 11) % 2147483647 * 69621 + 1) % 2147483647, id) - 1 AS perm FROM db),
    pos AS (SELECT {COS.format('a.e', 'b.e')} AS c FROM o a JOIN o b ON b.rn = a.rn + 1 AND a.rn % 2 = 0),
    neg AS (SELECT {COS.format('a.e', 'b.e')} AS c FROM o a JOIN o b ON b.perm = a.rn WHERE a.id <> b.id)
    SELECT round((SELECT avg(c) FROM pos), 6) AS pos_cos, round((SELECT avg(c) FROM neg), 6) AS neg_cos, round((SELECT avg(2 - 2 * c) FROM pos), 6) AS loss""")
def pos_neg_cosine(spark, sf_dir):
    """Positive pairs are neighbours by id, negative ones follow a seeded permutation."""
    db = site_db(spark, sf_dir).select("id", "e")
    rows = sampling.ranked(db, ["id"]).select("id", "e", "rn")
    perm = sampling.ranked(db.withColumn("h", sampling.mixed(F.col("id"))), ["h", "id"]).select(F.col("id").alias("id2"), F.col("e").alias("e2"), F.col("rn").alias("rn2"))
    nxt = rows.select(F.col("e").alias("e2"), (F.col("rn") - 1).alias("rn2"))
    pos = rows.where("rn % 2 = 0").join(nxt, F.col("rn") == F.col("rn2")).select(C.cosine(F.col("e"), F.col("e2")).alias("c")).agg(F.avg("c").alias("p"), F.avg(C.distance_loss(F.col("c"))).alias("l"))
    neg = rows.join(perm, F.col("rn") == F.col("rn2")).where("id <> id2").select(C.cosine(F.col("e"), F.col("e2")).alias("c")).agg(F.avg("c").alias("n"))
    return pos.join(F.broadcast(neg)).select(F.round("p", 6).alias("pos_cos"), F.round("n", 6).alias("neg_cos"), F.round("l", 6).alias("loss"))


@query("mean_pool", f"""WITH {DB_SQL} SELECT pdb, CAST(t.i - 1 AS INTEGER) AS dim, round(avg(e[t.i]), 6) AS mean FROM db, range(1, 65) t(i) GROUP BY pdb, t.i""")
def mean_pool(spark, sf_dir):
    return vectors.mean_pool(site_db(spark, sf_dir), ["pdb"], F.col("e")).select("pdb", F.posexplode("mean").alias("dim", "mean")).withColumn("mean", F.round("mean", 6))


@query("softmax_pool", f"""WITH {DB_SQL}, w AS (SELECT *, exp(e[1] - max(e[1]) OVER (PARTITION BY pdb)) AS w FROM db)
    SELECT pdb, CAST(t.i - 1 AS INTEGER) AS dim, round(tanh(sum(w * e[t.i]) / sum(w)), 6) AS pooled FROM w, range(1, 65) t(i) GROUP BY pdb, t.i""")
def softmax_pool(spark, sf_dir):
    db = site_db(spark, sf_dir)
    return vectors.softmax_pool(db, ["pdb"], F.element_at("e", 1), F.col("e")).select("pdb", F.posexplode("pooled").alias("dim", "pooled")).withColumn("pooled", F.round("pooled", 6))


@query("masked_mean", f"""WITH {DB_SQL} SELECT pdb, round(sum(e[1]) FILTER (id % 2 = 0) / nullif(count(*) FILTER (id % 2 = 0), 0), 6) AS mean FROM db GROUP BY pdb""")
def masked_mean(spark, sf_dir):
    m = (F.col("id") % 2 == 0).cast("double")
    db = site_db(spark, sf_dir)
    return db.groupBy("pdb").agg(F.round(F.try_divide(F.sum(F.element_at("e", 1) * m), F.sum(m)), 6).alias("mean"))


SCORED_SQL = "scored AS (SELECT l.doc_id, l.quality AS y, l.toxic, d.lang, CAST(d.n_chars AS DOUBLE) AS s FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _scored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("s"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("y"), "toxic", "lang", "s")


@query("auroc", f"""WITH {SCORED_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS rk FROM scored)
    SELECT lang, round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 6) AS auroc FROM r GROUP BY lang""")
def auroc(spark, sf_dir):
    return metrics.auroc(_scored(spark, sf_dir), "y", "s", ["lang"]).withColumn("auroc", F.round("auroc", 6))


@query("avg_precision", f"""WITH {SCORED_SQL}, g AS (SELECT lang, s, sum(y) AS p, count(*) AS n FROM scored GROUP BY lang, s), c AS (
        SELECT lang, p, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER (PARTITION BY lang) AS pos FROM g WINDOW w AS (PARTITION BY lang ORDER BY s DESC))
    SELECT lang, round(sum(CAST(p AS DOUBLE) / pos * tp / k), 6) AS average_precision FROM c GROUP BY lang""")
def avg_precision(spark, sf_dir):
    return metrics.average_precision(_scored(spark, sf_dir), "y", "s", ["lang"]).withColumn("average_precision", F.round("average_precision", 6))


@query("bce_loss", f"""WITH {SCORED_SQL}, l AS (SELECT y, s / 5000 - 1 AS x FROM scored)
    SELECT round(avg((1 - y) * x + (1 + 3.0 * y) * (ln(1 + exp(-abs(x))) + greatest(-x, 0.0))), 6) AS loss FROM l""")
def bce_loss(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("x", F.col("s") / 5000 - 1)
    return metrics.weighted_log_loss(rows, "y", "x", 4.0).withColumn("loss", F.round("loss", 6))


@query("confidence_bins", """WITH b AS (SELECT value, CASE WHEN value > 0 AND value <= 20 THEN 0 WHEN value > 20 AND value <= 40 THEN 1 WHEN value > 40 AND value <= 60 THEN 2 WHEN value > 60 AND value <= 80 THEN 3 WHEN value > 80 AND value <= 100 THEN 4 END AS bin FROM events)
    SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(value), 6) AS mean_value FROM b WHERE bin IS NOT NULL GROUP BY bin""")
def confidence_bins(spark, sf_dir):
    out = metrics.right_closed_bins(table(spark, sf_dir, "events"), "value", [0, 20, 40, 60, 80, 100], ["value"])
    return out.withColumn("mean_value", F.round("mean_value", 6))


@query("replicate_stats", """WITH r AS (SELECT user_id % 3 AS rep, avg(value) AS v FROM events GROUP BY 1) SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS n_runs FROM r""")
def replicate_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("rep", F.col("user_id") % 3)
    return metrics.replicate_stats(e, ["rep"], "value").select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n_runs")


@query("best_checkpoint", """SELECT user_id, arg_min(event_id, (value, event_id)) AS lowest, arg_max(event_id, (value, -event_id)) AS highest FROM events GROUP BY user_id""")
def best_checkpoint(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    low = metrics.best_step(e, ["user_id"], "event_id", "value", largest=False).withColumnRenamed("best_step", "lowest")
    return low.join(metrics.best_step(e, ["user_id"], "event_id", "value", largest=True).withColumnRenamed("best_step", "highest"), "user_id")


@query("embedding_moments_by_fold", f"""WITH {DB_SQL} SELECT CAST(id % 5 AS INTEGER) AS fold, round(avg(e[1]), 6) AS mean, round(stddev_pop(e[1]), 6) AS std FROM db GROUP BY 1""")
def embedding_moments_by_fold(spark, sf_dir):
    db = site_db(spark, sf_dir)
    x = F.element_at("e", 1)
    return db.groupBy((F.col("id") % 5).cast("int").alias("fold")).agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"))
