"""A capped graph looks at pairs only as far as a node's nearest may lie."""

from __future__ import annotations

import numpy as np

from sitewise.operators import spatial


def test_pairs_looked_at_grow_with_the_nodes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    at = np.concatenate([rng.normal(0, 0.1, (1200, 3)), np.full((400, 3), 0.05), rng.uniform(-2, 2, (40, 3)), [[9.0, 9, 9], [9.2, 9, 9]]])
    rows = [(i, "b" if i % 3 else "a", *map(float, p)) for i, p in enumerate(at)] + [(9000, None, 0.0, 0.0, 0.0), (9001, "a", None, 0.0, 0.0), (9002, "a", float("nan"), 0.0, 0.0)]
    nodes = spark.createDataFrame(rows, "n long, e string, x double, y double, z double").repartition(3)
    looked, join = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda *a, **k: looked.append(join(*a, **k)) or looked[-1])
    got: dict = {}
    for r in spatial.radius_graph(nodes, 1.0, "n", ["e"], most=4).collect():
        got.setdefault(r["src"], []).append((r["dist"], r["dst"]))
    apart = np.sqrt(((at[:, None] - at) ** 2).sum(2))
    want = {i: sorted((apart[i, j], j) for j in range(len(at)) if j != i and (i % 3 == 0) == (j % 3 == 0) and apart[i, j] <= 1)[:4] for i in range(len(at))}
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}
    pairs = [p.count() for p in looked]
    assert len(pairs) > 1 and sum(pairs) < 100 * len(at) < (apart <= 1).sum() / 5, pairs


def test_no_nodes(spark):
    none = spark.createDataFrame([], "n long, e int, x double, y double, z double")
    assert spatial.radius_graph(none, 1.0, "n", ["e"], most=4).count() == 0
