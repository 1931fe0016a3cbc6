"""Stand-ins: structural-site tables derived from the general test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectors import unit_vectors

#: SQL of the same tables for the oracles.
DB_SQL = """db AS (
    SELECT vec_id AS id, label AS letter, vec_id // 5 AS pdb, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
)"""
ATOMS_SQL = """atoms AS (
    SELECT vec_id AS atom_idx, label AS chain, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def site_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, letter (label), pdb (id div 5), e and the unit vector u."""
    v = table(spark, sf_dir, "embeddings")
    rows = v.select(F.col("vec_id").alias("id"), F.col("label").alias("letter"), F.expr("vec_id div 5").alias("pdb"), F.col("embedding").cast("array<double>").alias("e"))
    return unit_vectors(rows, "e")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """atom_idx, chain (label) and x, y, z: the first three components."""
    v = table(spark, sf_dir, "embeddings")
    place = [F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate("xyz")]
    return v.select(F.col("vec_id").alias("atom_idx"), F.col("label").alias("chain"), *place)


def aligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang and seq: the whole text, blanks and line ends as gaps. A row
    has a cell for each of its own characters and none beyond."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", F.translate("text", " \n", "--").alias("seq"))


def empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, col and ch of rows with an empty text. SQL's unnest gives such a
    row one cell: no character, in no column. The operators know no cell of theirs."""
    d = table(spark, sf_dir, "documents").where(F.col("text") == "")
    return d.select("doc_id", "lang", F.lit(None).cast("int").alias("col"), F.col("text").alias("ch"))


MSA_SQL = """msa AS (
    SELECT doc_id, lang, translate(text, ' ' || chr(10), '--') AS seq FROM documents
), cells AS (
    SELECT doc_id, lang, CAST(unnest(range(length(seq))) AS INTEGER) AS col, unnest(string_split(seq, '')) AS ch FROM msa
)"""
