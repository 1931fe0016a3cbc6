import random

import numpy as np

from sitewise.operators import search
from sitewise.operators.vectors import unit_vectors


def test_search_grid_equals_rounds_one_by_one(spark):
    """More searches than a word has bits, seeds that no row has, and a cutoff
    that nothing passes; what is reached comes once, not once a round."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows[5] = (5, [0.0] * 6)
    seeds = [(s, rng.randrange(150)) for s in range(30) for _ in range(2)] + [(30, 5), (30, 999)]
    cutoffs = {0.1: 0.75, 0.01: 0.9, 0.001: 1.5}
    db = unit_vectors(spark.createDataFrame(rows, "id long, embedding array<double>"))
    found, rounds = search.search_grid(db, spark.createDataFrame(seeds, "sample int, id long"), cutoffs, 4)
    u = np.array([v for _, v in rows])
    u = u / np.maximum(np.linalg.norm(u, axis=1), 1e-300)[:, None]
    cos = np.round(u @ u.T, 9)
    want, asked = {}, {}
    for s in range(31):
        for p, c in cutoffs.items():
            front = {i for k, i in seeds if k == s}
            for k in range(1, 5):
                own = [i for i in front if i < 150]
                hits = set(np.flatnonzero((cos[own] > c).any(0)).tolist()) if own else set()
                if hits:
                    asked[s, p, k] = len(front)
                for i in hits:
                    want.setdefault((s, p, i), k)
                front = hits
    got = [((r["sample"], r["p"], r["id"]), r["iter"]) for r in found.collect()]
    assert len(got) == len(want) and dict(got) == want
    assert {(r["sample"], r["p"], r["iter"]): r["n_query"] for r in rounds.collect()} == asked
