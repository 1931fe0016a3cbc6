"""Operator 11 against brute force, with hostile texts and small groups."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from sitewise.llm import token_groups as tg

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def brute(rows, percent=90, width=3):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if a and 100 * o >= percent * (len(a) + len(sets[j]) - o) and sets[j]:
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def rows_of(seed, n=160):
    """Chains of edited copies, some at the very threshold, passages that many share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["The", "the", "É", "é", "x\x1c", "漢字"]
    shared = " ".join(rng.choice(vocabulary) for _ in range(40))
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    rows, base = [], []
    for i in range(n):
        kind = rng.random()
        if base and kind < 0.6:
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            w = w[: len(w) - rng.choice([0, 0, 1, 5])] or ["w1"]
        else:
            w = words(rng.choice([1, 2, 3, 5, 30, 60, 100]))
        base.append(w)
        rows.append((rng.randrange(5 * n), (rng.choice(" \n\t\x0b").join(w) + (" " + shared if kind > 0.9 else "")).swapcase() if kind < 0.1 else " ".join(w)))
    ten = [f"t{i}" for i in range(21)]  # 19 shingles; with one more 19 of 20, with two of ten others 18 of 20
    rows += [(2000, " ".join(ten)), (2001, " ".join([*ten, "u"])), (2002, " ".join(ten[:11])), (2003, " ".join(ten[:12])), (2004, " ".join([*ten[:11], "z"]))]
    rows += [(None, " ".join(ten)), (None, "alone and without any id"), (None, None), (7, None), (7, ""), (8, " \n\t "), (9, "one"), (10, "One"), (11, "one two"), (12, "one one")]
    return rows + [(3000 + i, shared + f" n{i}") for i in range(30)] + [(4000, "long " * 30000), (4001, "LONG " * 5000)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, small, monkeypatch):
    if small:
        for name, value in {"GROUP_SETS": 3, "GROUP_TOKENS": 200, "ASKED_SETS": 2, "ASKED_TOKENS": 50, "HOT_SHARE": 20, "SLICE": 2}.items():
            monkeypatch.setattr(tg, name, value)
    rows = rows_of(5 if small else 6)
    df = spark.createDataFrame([(*r, 5, "k", 1, "t") for r in rows], "doc_id long, text string, n int, key string, _id int, _text string").repartition(3)
    found = tg.similar_documents(df)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    want = brute(rows)
    assert Counter(tuple(r) for r in found.collect()) == want
    assert len({r[2] for r in want}) < len(want) - 40  # many are linked


def test_no_rows_and_other_parameters(spark):
    kind = "doc_id long, text string"
    assert tg.similar_documents(spark.createDataFrame([], kind)).count() == 0
    assert [tuple(r) for r in tg.similar_documents(spark.createDataFrame([(1, None)], kind)).collect()] == [(1, 0, 1)]
    rows = [r for r in rows_of(9, 60) if len(r[1] or "") < 2000]
    got = tg.similar_documents(spark.createDataFrame(rows, kind), percent=70, width=5)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, 70, 5)


def test_members_are_asked_without_their_tokens_and_groups_shuffled_once(spark, monkeypatch):
    asked = []

    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    taken = PandasCogroupedOps.applyInArrow

    def apply(self, f, schema):
        asked.append((self._gd1._df.where("toks IS NOT NULL").select("key", "gid").collect(), self._gd1._df.where("toks IS NULL").count(), self._gd2._df._jdf.queryExecution().executedPlan().toString()))
        return taken(self, f, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", apply)
    rows = rows_of(7, 80)
    found = tg.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r) for r in found.collect()) == brute(rows)
    assert len(asked) == 2 and all(bare > 0 for _, bare, _ in asked)
    assert all("Exchange hashpartitioning" not in plan.split("BroadcastExchange")[0] for _, _, plan in asked)
