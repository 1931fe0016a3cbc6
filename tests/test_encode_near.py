"""Environments reach the encoder without their pairs being written."""

import random

from pyspark.sql import functions as F

from sitewise.operators import spatial
from sitewise.plans import pipelines


def test_encoder_sees_the_same_without_a_join(spark, monkeypatch):
    """Edges of cells and balls, null keys and places, small batches."""
    rng = random.Random(9)
    at = [[0.05 * rng.randrange(-8, 9) for _ in range(3)] for _ in range(160)] + [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(160)]
    rows = [(i, rng.choice("CNO"), rng.choice(["a", "b", None]), i % 2, *p) for i, p in enumerate(at)] + [(900, "C", "a", 0, None, 0.0, 0.0), (901, "C", "a", 0, float("nan"), 0.0, 0.0)]
    atoms = spark.createDataFrame(rows, "atom_idx int, element string, chain string, model int, x double, y double, z double").repartition(3)
    centers = atoms.where("atom_idx % 3 = 0").select(F.col("atom_idx").alias("residue"), "chain", "model", "x", "y", "z")
    monkeypatch.setattr(pipelines, "GRAPH_NODES", 40)
    encoder = lambda f: [[float(len(n)), float(len(e)), *[float(x["atom_idx"]) for x in n], *[x["dx"] + 3 * x["dy"] + 7 * x["dz"] + x["atom_type"] for x in n]] for n, e in zip(f["nodes"], f["edges"])]
    keys = ["chain", "model", "residue"]
    want = pipelines.encode(spatial.radius_join(centers, atoms, 0.25, ["model", "chain"]), keys, encoder, 0.15).collect()
    monkeypatch.setattr(spatial, "radius_join", None)
    found = pipelines.encode_near(centers, atoms, keys, ["model", "chain"], encoder, 0.25, 0.15)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want)) and len(want) > 50
    whole = pipelines.embed_protein(atoms.withColumns({"resname": F.lit("GLY"), "name": F.lit("CA"), "residue": F.col("atom_idx"), "bfactor": F.lit(1.0)}), lambda f: [[1.0]] * len(f), 0.25, 0.15)
    assert whole.count() == atoms.where("chain IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)").count()
