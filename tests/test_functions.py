"""Scalar functions and operators on hand-computed micro inputs."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from sitewise.functions import columns as C
from sitewise.functions import tables
from sitewise.operators import calibrate, filters, metrics, sampling, search, sequence, spatial, vectors


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("path,pdb,flag", [("a/pdb1abc.ent.gz", "1abc", False), ("x/AF-P1-F1.pdb", "AF-P1-F1", False), ("AF-P1-F1.cif", "P1", True), ("1abc.cif", None, None)])
def test_structure_names(spark, path, pdb, flag):
    assert one(spark, C.structure_id(F.lit(path))) == pdb
    assert one(spark, C.is_predicted(F.lit(path))) is flag


def test_lookup_defaults(spark):
    assert one(spark, C.residue_to_letter(F.lit("HOH"))) == "X"
    assert one(spark, C.letter_to_residue(F.lit("?"))) == "UNK"
    assert one(spark, C.letter_to_label(F.lit("E"))) == 5 and one(spark, C.letter_to_label(F.lit("X"))) == 20
    assert one(spark, C.element_label(F.lit("ZN"))) == 9 and one(spark, C.element_label(F.lit("Xx"))) == 12


def test_valences():
    assert tables.key_atoms("TRP")[1] == ["NE1"] and tables.key_atoms("UNK") == []


def test_radial_basis(spark):
    v = one(spark, C.radial_basis(F.lit(1.5)))
    assert v[5] == pytest.approx(1) and v[4] == pytest.approx(0.320531, abs=1e-6) and v[6] == pytest.approx(0.320531, abs=1e-6)


def test_edits(spark):
    assert one(spark, C.normalized_edits(F.lit("kitten"), F.lit("sitting"))) == pytest.approx(3 / 7)
    assert one(spark, C.normalized_edits(F.lit("a--b"), F.lit("a-cb"))) == pytest.approx(1 / 3)
    assert one(spark, C.normalized_edits(F.lit("--"), F.lit("--"))) is None


def test_mutation_and_resid(spark):
    assert tuple(one(spark, C.mutation_site(F.lit("1abc_AB12G")))) == ("B", 12)
    assert one(spark, C.resid_number(F.lit("H363"))) == 363 and one(spark, C.resid_number(F.lit("H180E"))) is None


def test_water_filter_keeps_the_substring_rule(spark):
    df = spark.createDataFrame([(" ",), ("W",), ("H_ZN",), ("H_XWZ",)], "hetero string")
    assert sorted(r[0] for r in filters.without_water(df).collect()) == [" ", "H_ZN"]


def test_quantiles_and_moments(spark):
    df = spark.createDataFrame([("a", x) for x in (0.1, 0.2, 0.4, 0.8, 0.9)], "g string, cos double")
    q = {round(r["p"], 4): r["cutoff"] for r in calibrate.quantile_cutoffs(df, ["g"], p_values=[0.5, 0.1, 0.01]).collect()}
    assert q[0.5] == pytest.approx(0.4) and q[0.1] == pytest.approx(0.86) and q[0.01] == pytest.approx(0.896)
    m = calibrate.moments(spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4)], "g int, cos double"), ["g"]).first()
    assert m["std"] == pytest.approx(1.118034, abs=1e-6)
    with pytest.raises(ValueError):
        calibrate.cutoff_of(df.withColumn("p", F.lit(0.1)), 0.123)


def test_percentile_is_strict_and_exact(spark):
    bg = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.2, 0.4)], "cos double")
    s = spark.createDataFrame([(x,) for x in (0.05, 0.2, 0.3, 0.5)], "cos double")
    assert [r["percentile"] for r in calibrate.percentile_scores(s, bg).orderBy("cos").collect()] == [0, 0.25, 0.75, 1]
    assert calibrate.percentile_scores(s, bg.limit(0)).first()["percentile"] is None


def test_smoothing_mirrors_short_sequences(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, 100.0)], "k int, pos long, v double")
    got = {r["pos"]: r["smooth"] for r in sequence.gaussian_smooth(df, ["k"], "pos", "v").collect()}
    assert got[0] == pytest.approx(49.999571, abs=1e-6) and got[1] == pytest.approx(50.000429, abs=1e-6)


def test_alignment_columns(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(["AAA-", "ACC-", "A-D-", "AAE-"])], "r int, seq string")
    cells = sequence.alignment_cells(rows, ["r"], "seq").withColumn("f", F.lit(1))
    e = {r["col"]: (r["entropy"], r["conservation"]) for r in sequence.column_entropy(cells, ["f"]).collect()}
    assert e[0] == (0, 1) and e[1][0] == pytest.approx(0.918296, abs=1e-6) and e[2][0] == pytest.approx(2) and e[3] == (0, 1)
    seq = sequence.alignment_cells(spark.createDataFrame([(0, "A-CX-D")], "r int, seq string"), ["r"], "seq")
    assert [r["seq_pos"] for r in sequence.ungapped_positions(seq, ["r"]).orderBy("col").collect()] == [0, -1, 1, 2, -1, 3]
    assert [r["seq_pos"] for r in sequence.sequence_positions(seq, ["r"]).orderBy("col").collect()] == [0, 1, 1, 2, 2, 2]


@pytest.mark.parametrize("n,k", [(10, 4), (3, 5), (79, 10)])
def test_array_split(spark, n, k):
    got = spark.range(n).select(sampling.array_split(F.col("id"), F.lit(n), k).alias("c")).groupBy("c").count().orderBy("c").collect()
    assert [r["count"] for r in got] == [n // k + (i < n % k) for i in range(k) if n // k + (i < n % k)]


def test_ranking_metrics_with_ties(spark):
    df = spark.createDataFrame(list(zip([1, 0, 1, 0, 1], [0.9, 0.8, 0.8, 0.3, 0.1])), "y int, s double")
    assert metrics.auroc(df, "y", "s").first()[0] == pytest.approx(0.583333, abs=1e-6)
    assert metrics.average_precision(df, "y", "s").first()[0] == pytest.approx(0.755556, abs=1e-6)
    assert metrics.auroc(df.where("y = 1"), "y", "s").first()[0] is None


def test_radius_join_boundary_and_brute_force(spark):
    pts = [(i, math.sin(i * 12.9) * 3, math.cos(i * 7.7) * 3, math.sin(i * 3.1) * 3) for i in range(120)] + [(200, 0.0, 0.0, 0.0), (201, 1.0, 0.0, 0.0), (202, None, 0.0, 0.0)]
    df = spark.createDataFrame(pts, "i int, x double, y double, z double")
    ok = [p for p in pts if p[1] is not None]
    dist = lambda a, b: math.sqrt(sum((u - v) ** 2 for u, v in zip(a[1:], b[1:])))
    for strict in (False, True):
        got = {(r["i"], r["p_i"]) for r in spatial.radius_join(df, df, 1.0, strict=strict).collect()}
        assert got == {(a[0], b[0]) for a in ok for b in ok if (dist(a, b) < 1 if strict else dist(a, b) <= 1)}
        assert ((200, 201) in got) is not strict
    near = {r["q"]: r["i"] for r in spatial.nearest_point(df.withColumnRenamed("i", "q").where("q < 20"), df.where("i >= 20"), "q", "i").collect()}
    assert near == {a[0]: min((dist(a, b), b[0]) for b in ok if b[0] >= 20)[1] for a in ok if a[0] < 20}


def test_cosine_cutoff_is_strict_and_blocks_agree(spark):
    df = vectors.unit_vectors(spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(40)], "id long, embedding array<double>"))
    a = {(r["q"], r["id"]) for r in vectors.similarity_join(df.withColumnRenamed("id", "q"), df, 0.5, "q", "id").collect()}
    b = {(r["q"], r["id"]) for r in vectors.similarity_join(df.withColumnRenamed("id", "q"), df, 0.5, "q", "id", block_rows=7).collect()}
    assert a == b == {(i, j) for i in range(40) for j in range(40) if round(math.cos(i - j), 9) > 0.5}


def test_search_stops_on_an_empty_frontier(spark):
    db = vectors.unit_vectors(spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0])], "id long, letter int, embedding array<double>"))
    cut = spark.createDataFrame([(1, 0.9)], "letter int, cutoff double")
    hits = search.iterative_search(db, db.where("id = 1"), cut, 5).collect()
    assert [(r["query"], r["id"], r["iter"]) for r in hits] == [(1, 1, 1)]


def test_group_folds_never_split_a_group(spark):
    df = spark.createDataFrame([(i, f"g{i % 13}") for i in range(100)], "o int, g string")
    got = sampling.group_folds(df, "g", "o", 5).groupBy("g").agg(F.countDistinct("fold").alias("n")).collect()
    assert len(got) == 13 and all(r["n"] == 1 for r in got)


def test_ema_schedule_folds_every_user(spark, tmp_path):
    from sitewise import registry

    rows = [(i, i * 7 % 45, f"2024-01-{1 + i * 11 % 28:02d}", float(i % 13)) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts string, value double").write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for event, user, ts, value in sorted(rows, key=lambda r: (r[2], r[0])):
        want[user] = want.get(user, 0.0) * 0.9 + value * 0.1
    got = {r["user_id"]: r["state"] for r in registry.queries()["ema_schedule"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(45)) and all(abs(got[u] - want[u]) < 2e-6 for u in want)


def test_record_filters_and_unbound_names(spark):
    ids = spark.createDataFrame([("a|pdb|1ABC|A",), ("a|sp|P1|B",), ("1abc_A",), ("P69905_A",), ("",), (None,)], "id string")
    got = {(f.__name__, p): {r.id for r in f(ids, p).collect()} for f in (filters.structure_records, filters.sequence_records) for p in (False, True)}
    assert got == {
        ("structure_records", False): {"a|pdb|1ABC|A"}, ("structure_records", True): {"a|pdb|1ABC|A", "a|sp|P1|B"},
        ("sequence_records", False): {"1abc_A"}, ("sequence_records", True): {"1abc_A", "P69905_A", ""},
    }
    pairs = spark.createDataFrame([("l_bound", "x_b_1", None, "y_b_b_")], "subunit0 string, structure0 string, subunit1 string, structure1 string")
    assert tuple(filters.to_unbound(pairs).first()) == ("l_unbound", "x_u_1", None, "y_u_b_")
