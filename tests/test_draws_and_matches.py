"""Record matches, edit joins, decaying averages and draws against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sitewise.operators import sampling, sequence, spatial
from sitewise.plans import pipelines


def test_match_records(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ab|1É") for _ in range(rng.randrange(n)))
    ids = [(i, text(12)) for i in range(120)] + [(500, None), (501, "")]
    keys = [text(7) for _ in range(60)] + ["", None, "zzzz", "aa|"]
    left = spark.createDataFrame([(k, f"s{i}") for i, k in enumerate(keys)], "key string, seq string")
    right = spark.createDataFrame(ids, "ord int, rid string")
    got = {r["seq"]: (r["ord"], r["rid"]) for r in sequence.match_records(left, right, "key", "rid", "ord").collect()}
    want = {}
    for i, k in enumerate(keys):
        found = [x for x in sorted(ids, key=lambda x: x[0]) if k is not None and x[1] is not None and k in x[1]]
        if found:
            want[f"s{i}"] = found[0]
    assert got == want and len(want) > 20
    plan = sequence.match_records(left, right, "key", "rid", "ord")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "contains" in plan.lower()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_close_records(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 4, 9, 14, 20, 30)]
    rows = []
    for i in range(90):
        s = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            s.insert(rng.randrange(len(s) + 1), rng.choice("abc")) if rng.random() < 0.5 or not s else s.pop(rng.randrange(len(s)))
        rows.append((i, "".join(s)))
    df = spark.createDataFrame([*rows, (900, None)], "id int, s string")
    for k in (0, 1, 3):
        got = {(r["a"], r["b"]): r["edits"] for r in sequence.close_records(df, "id", "s", k).collect()}
        want = {(i, j): d for i, s in rows for j, t in rows if i < j and (d := edits(s, t)) <= k}
        assert got == want and want


def test_close_records_of_common_parts(spark):
    """Numbered texts of one name: each meets those near its number, not all."""
    rng = random.Random(9)
    rows = [(i, f"large ring {i:06d}") for i in rng.sample(range(1_000_000), 1500)] + [(2_000_000, "large ring 000000")]
    rows += [(3_000_000 + i, "x" * n + "y" * (i % 2)) for i, n in enumerate((31, 32, 33, 34, 35, 36, 37, 38))]
    df = spark.createDataFrame(rows, "id int, s string")
    met = df.select("s").mapInArrow(sequence._remains(2), "h long, s string").groupBy("h").count().selectExpr("sum(count * (count - 1) / 2)").first()[0]
    assert met < len(rows) ** 2 / 20
    got = {(r["a"], r["b"]): r["edits"] for r in sequence.close_records(df, "id", "s", 2).collect()}
    near = lambda s, t: abs(len(s) - len(t)) <= 2 and sum(x != y for x, y in zip(s[-6:], t[-6:])) + (s[-1] == "y") + (t[-1] == "y") <= 6
    want = {(i, j): d for i, s in rows for j, t in rows if i < j and near(s, t) and sum(s.count(c) != t.count(c) for c in "0123456789") <= 4 and (d := edits(s, t)) <= 2}
    assert got == want


@pytest.mark.parametrize("beta, period", [(0.9, 5000.0), (0.5, 4.0), (0.0, 7.0)])
def test_scheduled_average(spark, beta, period):
    rng = random.Random(6)
    rows = [(rng.choice(["long"] * 8 + ["x", "y"]), i, rng.gauss(0, 5)) for i in range(400)]
    want, groups = {}, defaultdict(list)
    for k, _, v in rows:
        groups[k].append(v)
    for k, vs in groups.items():
        state, share = vs[0], 1 - beta
        for i, v in enumerate(vs[1:], 1):
            share *= (math.cos(math.pi * i / period) + 1) / 2
            state = (1 - share) * state + share * v
        want[k] = state
    df = spark.createDataFrame(rows, "k string, i int, v double")
    assert {r["k"]: r["state"] for r in sequence.scheduled_average(df, ["k"], ["i"], "v", beta, period).collect()} == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_drawn_negatives(spark):
    left = spark.createDataFrame([(e, r) for e in (1, 2, 3) for r in range(12)], "e int, residue long")
    right = spark.createDataFrame([(e, r) for e in (1, 2, 3) for r in range(5)], "e int, residue long")
    positives = [(1, i, i % 5) for i in range(12)] + [(2, i, j) for i in range(12) for j in range(5) if (i, j) != (3, 3)]
    pos = spark.createDataFrame(positives, "e int, residue0 long, residue1 long")
    wanted = spark.createDataFrame([(1, 20), (2, 20), (3, 7)], "e int, wanted long")
    got = [tuple(r) for r in sampling.drawn_negatives(left, right, pos, wanted, ["residue"], ["e"]).collect()]
    assert Counter(r[0] for r in got) == {1: 20, 2: 1, 3: 7}
    assert len(set(got)) == len(got) and not set(got) & set(positives)
    assert all(0 <= a < 12 and 0 <= b < 5 for _, a, b in got)


def test_a_chosen_group_of_functional_atoms(spark):
    atoms = spark.createDataFrame([(1, "TRP", "CD2", 0.0), (1, "TRP", "CE2", 2.0), (1, "TRP", "NE1", 8.0), (2, "ALA", "CB", 5.0), (3, "XXX", "CA", 1.0)], "residue int, resname string, name string, x double")
    atoms = atoms.withColumn("y", F.lit(0.0)).withColumn("z", F.lit(0.0))
    at = lambda choose: {r["residue"]: r["x"] for r in spatial.functional_centers(atoms, ["residue", "resname"], choose=choose).collect()}
    assert at(None) == {1: 10 / 3, 2: 5.0, 3: 1.0}
    assert at(F.lit(0)) == {1: 1.0, 2: 5.0, 3: 1.0}
    assert at(F.lit(1)) == at(F.lit(3)) == {1: 8.0, 2: 5.0, 3: 1.0}


def test_positive_pairs_of_small_families(spark):
    df = spark.createDataFrame([("one", 1, "abc"), ("two", 2, "a-c"), ("two", 3, "-Xc"), ("gap", 4, "a--"), ("gap", 5, "--a"), ("gap", 6, None)], "f string, rec int, seq string")
    rows = [r.asDict() for r in pipelines.positive_pairs(df, "f", "rec", "seq", ["a", "b", "c"], 5).collect()]
    assert len(rows) == 1
    row = rows[0]
    assert (row["f"], row["col"], row["letter0"], row["letter1"], row["conservation"]) == ("two", 2, "c", "c", 1.0)
    assert {row["rec0"]: row["pos0"], row["rec1"]: row["pos1"]} == {2: 1, 3: 0}
