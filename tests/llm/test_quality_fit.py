"""The quality rules' model: every labelled row has its say."""

from __future__ import annotations

import numpy as np

from sitewise.llm import quality


def labelled(spark, n):
    """Good rows, and one in ten bad: of symbols, many of them or few."""
    texts = [(i, " ".join(f"w{(i * 7 + k) % 97}" for k in range(30 + i % 40)) + (" #$%" * (1 + i % 25) if i % 10 == 0 else "")) for i in range(n)]
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(n)], "doc_id long, quality int")


def test_threshold_counts_every_labelled_row(spark, monkeypatch):
    """More labelled rows than the trees hold: all are counted, each as scored by
    trees that have not seen it."""
    monkeypatch.setattr(quality, "TREES", 10)
    monkeypatch.setattr(quality, "TREE_ROWS", 16)
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 40, raising=False)  # as it once was
    seen = []
    was = quality.QualityModel.calibrate
    monkeypatch.setattr(quality.QualityModel, "calibrate", lambda self, cuts, clean, junk: (seen.append((cuts, clean, junk)), was(self, cuts, clean, junk))[1])
    docs, labels = labelled(spark, 600)
    model = quality.fit_quality(docs, labels)
    rows = quality.labelled_ratios(docs, labels).selectExpr("y", "r", "pmod(xxhash64('fold', i), 5) AS fold").collect()
    cuts, clean, junk = seen[0]
    assert (clean.sum(), junk.sum()) == (540, sum(r["y"] == 0 for r in rows)) and junk.sum() > 50
    ratios, fold, good = np.array([r["r"] for r in rows]), np.array([r["fold"] for r in rows]), np.array([r["y"] for r in rows]) == 1
    level = model.levels(ratios, fold)
    assert [((level == c) & good).sum() for c in cuts] == clean.tolist()
    assert (level[good] > model.threshold).mean() <= quality.CLEAN_LOSS


def test_odd_labels(spark):
    docs, labels = labelled(spark, 60)
    odd = spark.createDataFrame([(0, 1), (5, None), (None, 1), (999, 0)], "doc_id long, quality int")
    twice = docs.where("doc_id = 7").unionByName(docs).unionByName(spark.createDataFrame([(None, "x " * 30)], docs.schema))
    rows = {r["i"]: (r["y"], r["r"]) for r in quality.labelled_ratios(twice, labels.unionByName(odd)).collect()}
    want = {r["i"]: (r["y"], r["r"]) for r in quality.labelled_ratios(docs, labels).collect()}
    assert rows == want | {0: (1, want[0][1])}
    none = quality.fit_quality(docs, labels.where("quality = 1"))
    assert not none.rejects(np.ones((2, 7))).any()
