"""A capped graph hands on no pairs that can't be among a node's nearest."""

from __future__ import annotations

import numpy as np

from sitewise.operators import spatial


def test_pairs_are_thinned_before_the_shuffle(spark):
    rng = np.random.default_rng(2)
    at = np.round(rng.uniform(0, 1, (700, 3)), 1)  # equal distances and equal places too
    nodes = spark.createDataFrame([(i, i % 2, *map(float, p)) for i, p in enumerate(at)], "n long, e int, x double, y double, z double").repartition(3)
    got = {}
    for r in spatial.radius_graph(nodes, 0.5, "n", ["e"], most=4).collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    apart = np.sqrt(((at[:, None] - at) ** 2).sum(2))
    for i in range(700):
        others = [j for j in range(700) if j != i and j % 2 == i % 2 and apart[i, j] <= 0.5]
        # the same sum in another order may round otherwise: compare distances
        want = sorted(np.round(apart[i, others], 9))[:4]
        assert sorted(np.round(apart[i, sorted(got.get(i, ()))], 9)) == want
    every = spatial.radius_join(nodes, nodes, 0.5, ["e"])
    thin = spatial._thinned(every, ["e", "n"], ["dist", "p_n"], 4)
    assert every.count() > 50_000 and thin.count() < every.count() / 4
