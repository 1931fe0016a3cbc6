import math
import random

from sitewise.plans import pipelines


def test_encoder_sees_few_environments_at_once(spark, monkeypatch):
    """Graphs over several batches, null keys, nodes in order; no frame of many."""
    monkeypatch.setattr(pipelines, "GRAPH_NODES", 50)
    monkeypatch.setattr(pipelines, "EDGE_ROWS", 7)
    rng = random.Random(5)
    rows = [(k, i, rng.choice("CNO"), 0.0, 0.0, 0.0, rng.random(), rng.random(), rng.random()) for k, n in ((None, 3), (1, 12000), (2, 20), (3, 20), (4, 20), (5, 1)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, p_atom_idx int, p_element string, x double, y double, z double, p_x double, p_y double, p_z double")

    def encoder(frame):
        most = max(len(n) for n in frame["nodes"])
        assert sum(len(n) for n in frame["nodes"]) <= max(50, most)
        assert all([x["atom_idx"] for x in n] == list(range(len(n))) for n in frame["nodes"])
        return [[len(n), len(e)] for n, e in zip(frame["nodes"], frame["edges"])]

    small = df.where("k IS NULL OR k <> 1")
    got = {r["k"]: r["embedding"] for r in pipelines.encode(small, ["k"], encoder, 0.4).collect()}
    want = {}
    for k in (None, 2, 3, 4, 5):
        at = [r[6:] for r in rows if r[0] == k]
        want[k] = [len(at), sum(math.dist(a, b) <= 0.4 for i, a in enumerate(at) for j, b in enumerate(at) if i != j)]
    assert got == want
    sizes = {r["k"]: r["embedding"][0] for r in pipelines.encode(df, ["k"], encoder, 0.0).collect()}
    assert sizes == {None: 3, 1: 12000, 2: 20, 3: 20, 4: 20, 5: 1}
