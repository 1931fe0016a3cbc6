"""Every registered corpus query gives the same rows beside columns whose names clash."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitewise.llm.queries import QUERIES

NAMES = [
    "_n_lines", "_n_removed", "_counts", "counts", "_row", "_id", "_rid", "_text", "_spans", "found", "n", "n_lines", "n_tokens", "key", "check", "token",
    "count", "uid", "whole", "asks", "squares", "fingerprint", "component_id", "score", "rank", "h", "r", "blob", "gid", "lang_pred", "word", "toks",
]


@pytest.fixture(scope="module")
def beside(spark, sf, tmp_path_factory):
    """The small tables, with and without a column of each name."""
    places = [str(tmp_path_factory.mktemp(x)) for x in ("plain", "clash")]
    for name in ("documents", "embeddings", "labels"):
        t = spark.read.parquet(f"{sf}/{name}.parquet")
        if name == "documents":
            t = t.where("doc_id % 3 = 0 OR doc_id < 60")
        t.write.parquet(os.path.join(places[0], f"{name}.parquet"))
        t.select("*", *[F.lit(f"{c} clash").alias(c) for c in NAMES if c not in t.columns]).write.parquet(os.path.join(places[1], f"{name}.parquet"))
    return places


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_beside_clashing_columns(spark, beside, name):
    plain, clash = (QUERIES[name](spark, d) for d in beside)
    assert plain.columns == clash.columns
    same = lambda df: Counter(tuple(r[c] for c in df.columns if c != "sequence_id") for r in df.collect())
    got = same(clash)
    if name in ("op9_best_fit_packing", "op4_toxicity", "op7_language_id"):  # equal documents may swap places
        assert sum(got.values()) == plain.count() > 0
    else:
        assert got == same(plain) and got
