"""Each stage of the pipeline against a plain version of what it promises."""

from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline as pipeline

from sitewise.llm.common import materialize
from sitewise.llm.simhash import fingerprint


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {"input": docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf))
        assert docs.columns == columns
        seen[name] = docs.collect()
    quality, lines, near, secrets = (seen[n] for n in ("quality rules", "line dedup", "simhash near-dedup", "secret scans"))
    assert {r["doc_id"] for r in quality} < {r["doc_id"] for r in seen["input"]}
    assert Counter(r["doc_id"] for r in lines) == Counter(r["doc_id"] for r in quality)
    kept = [x for r in lines for x in r["text"].lower().split("\n") if x.split()]
    assert len(kept) == len({" ".join(x.split()) for x in kept})
    prints = {r["doc_id"]: fingerprint(r["text"], 5) for r in lines}
    kept_ids = {r["doc_id"] for r in near}
    for i, p in prints.items():
        linked = [j for j, q in prints.items() if j != i and (p ^ q).bit_count() <= 3]
        assert linked or i in kept_ids
    assert not any((prints[i] ^ prints[j]).bit_count() <= 3 for i in kept_ids for j in kept_ids if i < j)
    assert {r["doc_id"] for r in secrets} == kept_ids
    assert not any(re.search(r"[0-9a-f]{16,}", r["text"]) for r in secrets)
    packed = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == kept_ids
    used = Counter()
    for r in packed:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048
    assert len(used) <= 1.05 * sum(used.values()) / 2048 + 2


def test_null_and_repeated_rows(spark, sf):
    rows = [(1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", None, None, None), (None, "x y z", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES[1:]:
        stage(spark, docs, sf).collect()
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert len([r for r in pipeline.near_dedup(spark, docs, sf).collect() if r["doc_id"] == 1]) == 1


def test_near_dedup_decides_by_row(spark, sf):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(0)), (1, text(1)), (2, text(1)), (2, text(2)), (None, text(2)), (None, text(3)), (None, text(3)), (3, text(0))]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in pipeline.near_dedup(spark, docs, sf).collect()]
    assert Counter(kept) == Counter([(1, text(0)), (1, text(1)), (2, text(2)), (None, text(3))])


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def edited_copies(seed=4):
    """Re-wrapped copies, and copies of copies, with a few words replaced."""
    rng = random.Random(seed)
    texts = []
    for g in range(12):
        group = [[f"g{g}w{i}" for i in range(rng.choice([3, 6, 40, 120, 300]))]]
        for k in range(6):
            w = list(rng.choice(group))
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"e{k}x{rng.randrange(99)}"
            group.append(w)
        texts += ["".join(x + rng.choice(" \n  ") for x in w) for w in group]
    rng.shuffle(texts)
    return texts


def test_near_dedup_at_four_fifths(spark, sf):
    texts = [*edited_copies(), "", " \n", None]
    ids = [*range(len(texts) - 3), 900, None, None]
    sets = [shingles(t or "") for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    want = Counter(ids[i] for i in range(len(texts)) if root[i] == i)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert Counter(r["doc_id"] for r in pipeline.near_dedup(spark, docs, sf).collect()) == want
    assert 20 < len(want) < len(texts) - 20
