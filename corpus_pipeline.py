"""A corpus pipeline: quality rules, line dedup, near-dedup, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes
each stage's rows as Parquet into the shared folder and reads them back as the
next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.llm.common import materialize, numbered, table
from sitewise.llm.line_dedup import dedup_lines, near_copies
from sitewise.llm.packing import pack_documents
from sitewise.llm.quality import fit_quality, keep_good
from sitewise.llm.queries import tokenizer_path
from sitewise.llm.secrets import labelled_strings, markov_ratio, redact_secrets
from sitewise.llm.simhash import simhash_fingerprints


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; rejected ones go."""
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; every document stays."""
    return dedup_lines(docs, percent=80)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that of the smallest id.

    SimHash fingerprints of five-word shingles link documents that differ in
    three bits at most. Documents whose shingle sets have a Jaccard similarity of
    0.8 differ in ten bits of 64, too many for blocks of a fingerprint: op8's
    exact join adds every link from that similarity on. Documents that line dedup
    left without a word are copies of each other. Each row is a document of its
    own, whatever its id; rows without an id come last.
    """
    rows = numbered(docs)
    texts = rows.select("_rid", "_id", F.col("_row.text").alias("_text"))
    prints = simhash_fingerprints(texts, "_rid", "_text", words=5)
    copies = near_copies(texts, percent=80, prints=prints, most=3)
    return rows.join(copies.hint("merge"), "_rid", "left_anti").select("_row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret in their text replaced; every document stays."""
    return redact_secrets(docs, markov_ratio(labelled_strings(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 2048 tokens."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

# Token ids and fingerprints are not SQL's to compute: tests/llm compares each
# stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
