"""Statistics of a site's cosines to a whole side against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from sitewise.operators import pair_scores, vectors


@pytest.mark.parametrize("held", [1 << 22, 40])
def test_top_statistics(spark, monkeypatch, held):
    monkeypatch.setattr(pair_scores, "HELD_VALUES", held)
    monkeypatch.setattr(vectors, "BLOCK_VALUES", 64)  # blocks of 16 rows: many strips
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[int(i % 7 == 0)], rng.normal(size=4).tolist()) for i in range(300)]
    sites = [r for r in rows if r[0] % 3 == 0] + [(0, "a", [1.0, 2.0, 3.0, 4.0]), (901, "c", [1.0, 0.0, 0.0, 0.0]), (902, "a", None), (903, None, [1.0] * 4), (904, "a", [1.0, 2.0]), (905, "b", [float("nan")] * 4)]
    others = [r for r in rows if r[0] % 3] + [(910, "a", [1.0, None, 2.0, 2.0]), (911, "a", [0.0] * 4), (912, "a", [float("nan")] * 4)]
    make = lambda x, name: vectors.unit_vectors(spark.createDataFrame(x, f"{name} long, g string, embedding array<double>"))
    levels = [0.999, 0.99, 0.9]
    left, right = make(sites, "site_id"), make(others, "id")
    found = pair_scores.top_statistics(left, right, "site_id", "id", "g", levels).collect()
    whole = lambda v: v is not None and None not in v
    want: dict = {}
    others = right.select("g", "u").collect()
    for i, g, v in left.select("site_id", "g", "u").collect():
        if whole(v):
            cos = [np.dot(v, w) for h, w in others if h == g and whole(w) and len(w) == len(v)]
            want.setdefault(i, []).extend(x for x in cos if not np.isnan(x))
    want = {i: x for i, x in want.items() if x}
    assert {r["site_id"]: r["n"] for r in found} == {i: len(x) for i, x in want.items()} and len(found) == 100
    for r in found:
        x = want[r["site_id"]]
        assert (r["mean"], r["std"]) == pytest.approx((np.mean(x), np.std(x)), abs=1e-9)
        assert [q["level"] for q in r["quantiles"]] == levels
        assert [q["quantile"] for q in r["quantiles"]] == pytest.approx(np.quantile(x, levels), abs=1e-9)


def test_pairs_are_not_written(spark, sf, monkeypatch):
    from sitewise.plans import queries_search

    monkeypatch.setattr(vectors, "similarity_join", None)
    assert queries_search.site_background(spark, sf).count() == queries_search.build_site_db(spark, sf).select("site_id").distinct().count() > 100
