"""Annotation hands on only pairs above the site's own cutoff, and joins them to nothing."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from sitewise.operators import search
from sitewise.operators.vectors import unit_vectors


def test_annotation_writes_hits_only(spark, monkeypatch):
    rng = random.Random(8)
    v = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(160)]
    cuts = [rng.choice([None, float("nan"), -0.9, 0.1, 0.5, 0.8]) for _ in range(80)]
    sites = [(i, None if i % 9 == 0 else f"p{i % 7}", None if i % 11 == 0 else f"r{i % 5}", f"s{i % 3}", f"o{i % 2}", cuts[i], v[i]) for i in range(80)]
    residues = [(i, f"p{i % 7}", f"c{i % 50}", v[i]) for i in range(80, 160)]
    s = unit_vectors(spark.createDataFrame(sites, "site_id long, pdb string, resid string, site string, source string, site_cutoff double, e array<double>"), "e")
    r = unit_vectors(spark.createDataFrame(residues, "res_id long, pdb string, chain_resid string, e array<double>"), "e")
    u = np.array(v) / np.linalg.norm(v, axis=1)[:, None]
    cos = np.round(u @ u.T, 9)
    above = [(x, y) for x in residues for y in sites if y[5] is not None and cos[x[0], y[0]] > max(0.2, y[5]) and y[5] == y[5]]
    want: dict = {}
    for x, y in above:
        if y[1] is not None and y[1] != x[1]:
            want.setdefault((x[1], y[3], y[4], x[2]), set()).add((y[1], ": ".join(t for t in y[1:3] if t is not None)))
    made, join = [], search.similarity_join
    monkeypatch.setattr(search, "similarity_join", lambda *a, **k: made.append(join(*a, **k)) or made[-1])
    found = search.annotate(r, s, 0.2)
    got = {(x["query_pdb"], x["site"], x["source"], x["chain_resid"]): (x["n_hits"], x["n_pdbs"], x["evidence"]) for x in found.collect()}
    assert got == {k: (len({e for _, e in t}), len({p for p, _ in t}), sorted({e for _, e in t})) for k, t in want.items()} and got
    assert made[0].count() == len(above)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Expand" not in plan  # blocks with blocks
    assert dict(found.dtypes)["n_hits"] == "bigint" and found.where(F.col("n_pdbs") < 1).isEmpty()
