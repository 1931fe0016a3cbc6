"""Readers and writers of site lists, alignments, features and results.

Schemas are explicit everywhere; nothing is inferred or evaluated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METADATA = "pdb string, Description string, Classification string, Keywords string, Method string, Uniprot string, Citation string"
SITE_COORDS = "map<string, struct<coords: array<array<double>>, labels: array<int>>>"


def read_residue_list(spark: SparkSession, path: str) -> DataFrame:
    """pdb, chain, residue (text: it may hold insertion codes) of a TSV without header."""
    return spark.read.csv(path, sep="\t", schema="pdb string, chain string, residue string")


def read_metadata(spark: SparkSession, path: str, sep: str = ",", schema: str = METADATA) -> DataFrame:
    return spark.read.csv(path, header=True, sep=sep, schema=schema)


def read_site_list(spark: SparkSession, path: str) -> DataFrame:
    """site, pdb (four characters), chain, locs (array of int), source, desc."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', schema="site string, pdb string, locs string, source string, desc string")
    return raw.select("site", F.substring("pdb", 1, 4).alias("pdb"), F.substr("pdb", F.lit(5)).alias("chain"), parse_locs(F.col("locs")).alias("locs"), "source", "desc")


def parse_locs(text: Column) -> Column:
    """A list literal of whole numbers; null if it is none."""
    return F.from_json(text, "array<int>")


def read_site_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """pdb, x, y, z, label of a JSON object of coordinates and labels by pdb."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", SITE_COORDS)).alias("pdb", "s"))
    rows = whole.select("pdb", F.explode(F.arrays_zip(F.col("s.coords").alias("c"), F.col("s.labels").alias("l"))).alias("r"))
    return rows.select("pdb", *[F.try_element_at("r.c", F.lit(i + 1)).alias(c) for i, c in enumerate("xyz")], F.col("r.l").alias("label"))


def read_id_lists(spark: SparkSession, path: str) -> DataFrame:
    """pdb, ord (from 0), resid of JSON objects of residue id lists by pdb, one a line.

    Empty and null lists give no row; a line that is no such object gives none.
    """
    whole = spark.read.text(path).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("pdb", "ids"))
    return whole.select("pdb", F.posexplode("ids").alias("ord", "resid"))


def write_id_lists(df: DataFrame, path: str, key: str = "pdb", order: str = "ord", value: str = "resid") -> None:
    """One JSON object a line, each of one key and its list in order: {"1abc": ["A1", ...]}.

    A list is one structure's, so it fits in a row. Rows without a key or an id
    are left out.
    """
    lists = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_l"))
    entry = F.create_map(F.col(key).cast("string"), F.transform("_l", lambda x: x[value]))
    lists.select(F.to_json(entry).alias("value")).write.text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """path, ord (place of the record in the partition's reading order), id, description, seq.

    A record begins at a line that begins with >; the sign may stand in a header too.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "^>", "").alias("value")).withColumn("ord", F.monotonically_increasing_id())
    lines = F.split("value", "\r?\n")
    head = F.try_element_at(lines, F.lit(1))
    seq = F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: F.trim(x)), "")
    return raw.where(F.length(F.trim("value")) > 0).select("path", "ord", F.element_at(F.split(head, r"\s+"), 1).alias("id"), head.alias("description"), seq.alias("seq"))


def write_fasta(df: DataFrame, path: str, id_col: str = "id", seq_col: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), F.col(seq_col)).alias("value")).write.text(path)


def read_feature_vectors(spark: SparkSession, path: str) -> DataFrame:
    """path, ord, name, vector of feature files.

    The line with PDBID_LIST names the rows (its third token on, commas off);
    the others hold numbers in their second to sixth-last token. Files whose
    names and rows differ in number raise an error.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\r?\n").alias("lines"))
    is_names = lambda x: x.startswith("#") & x.contains("PDBID_LIST")
    names = F.transform(F.slice(F.split(F.try_element_at(F.filter("lines", is_names), F.lit(1)), r"\s+"), 3, 1 << 30), lambda x: F.replace(x, F.lit(","), F.lit("")))
    rows = F.filter("lines", lambda x: (F.length(F.trim(x)) > 0) & ~x.startswith("#"))
    vector = lambda x: F.transform(F.slice(F.split(F.trim(x), r"\s+"), 2, F.greatest(F.size(F.split(F.trim(x), r"\s+")) - 6, F.lit(0))), lambda v: v.cast("double"))
    both = raw.select("path", F.filter(names, lambda x: x != "").alias("names"), F.transform(rows, vector).alias("rows"))
    same = F.assert_true(F.size("names") == F.size("rows"), F.lit("names and rows differ in number"))
    checked = both.where(same.isNull())
    return checked.select("path", F.posexplode(F.arrays_zip("names", "rows")).alias("ord", "r")).select("path", "ord", F.col("r.names").alias("name"), F.col("r.rows").alias("vector"))


def zip_features(a: DataFrame, b: DataFrame, labels: DataFrame) -> DataFrame:
    """Two feature files row by row, with the label of the name; unlabelled rows drop out."""
    left = a.select("ord", "name", F.col("vector").alias("vector_a"))
    return left.join(b.select("ord", F.col("vector").alias("vector_b")), "ord").join(labels, "name")


def write_records(df: DataFrame, path: str, required: str | None = None, partition_by: Sequence[str] = ()) -> None:
    """Parquet, without the rows whose ``required`` column is null."""
    rows = df if required is None else df.where(F.col(required).isNotNull())
    rows.write.partitionBy(*partition_by).parquet(path) if partition_by else rows.write.parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def new_records(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has no output yet."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def keyed_union(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The union of parts in which, for each key, the last part wins."""
    rows = None
    for i, part in enumerate(parts):
        one = part.withColumn("_part", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    w = Window.partitionBy(*keys).orderBy(F.desc("_part"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_part")
