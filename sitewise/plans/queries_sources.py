"""Queries through files: tables are written in each format and read by its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.settle import scratch
from ..registry import query
from ..sources import structures, tables
from .queries_features import NAMED_SQL, named
from .standins import DB_SQL, site_db, table

HUNDREDS = f"""WITH {NAMED_SQL}, s AS (SELECT *, atom_idx // 100 AS file FROM named)"""


def _structures(spark, sf_dir, compression="none"):
    a = named(spark, sf_dir).withColumn("file", F.expr("atom_idx div 100")).withColumn("bfactor", F.lit(50.0))
    path = scratch(spark)
    structures.write_structures(a.withColumns({c: F.col(c) * 10 for c in "xyz"}), path, "file", compression)
    return path


def _file():
    return F.regexp_extract("path", r"file=(\d+)", 1).cast("long").alias("file")


@query("source_structures", f"""{HUNDREDS} SELECT file, row_number() OVER (PARTITION BY file ORDER BY atom_idx) - 1 AS ord, CAST(chain AS VARCHAR) AS chain, CAST(residue AS INTEGER) AS residue, resname, name, element,
    round(x * 10, 3) AS x, round(y * 10, 3) AS y, round(z * 10, 3) AS z FROM s""")
def source_structures(spark, sf_dir):
    """Structure files, packed, and their atoms again."""
    atoms = structures.read_structures(spark, _structures(spark, sf_dir, "gzip"), "*.gz")
    return atoms.select(_file(), F.col("atom_idx").alias("ord"), "chain", "residue", "resname", "name", "element", "x", "y", "z")


@query("source_file_report", f"{HUNDREDS} SELECT file, count(*) AS n_atoms, TRUE AS fine FROM s GROUP BY file")
def source_file_report(spark, sf_dir):
    """How many atoms each file holds, and whether it could be read."""
    report = structures.file_report(structures.structure_files(spark, _structures(spark, sf_dir), "*.txt"))
    return report.select(_file(), "n_atoms", F.col("problem").isNull().alias("fine"))


@query("source_residue_list", """SELECT lower(source) AS pdb, chr(65 + CAST(doc_id % 4 AS INTEGER)) AS chain, CASE WHEN doc_id % 9 = 0 THEN doc_id || 'A' ELSE CAST(doc_id AS VARCHAR) END AS residue FROM documents""")
def source_residue_list(spark, sf_dir):
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.lower("source"), F.char(65 + i % 4), F.concat(i.cast("string"), F.when(i % 9 == 0, "A").otherwise("")))
    path = scratch(spark)
    rows.write.csv(path, sep="\t")
    return tables.read_residue_list(spark, path)


@query("source_site_list", """SELECT 'S' || (l_orderkey % 50) AS site, 'p' || lpad(CAST(l_orderkey % 1000 AS VARCHAR), 3, '0') AS pdb, chr(65 + CAST(l_orderkey % 4 AS INTEGER)) AS chain, CAST(l_orderkey AS BIGINT) AS source,
    count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey""")
def source_site_list(spark, sf_dir):
    """A site list with list literals in quotes."""
    k = F.col("l_orderkey")
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(F.col("l_linenumber").cast("string"))), ", "), F.lit("]")).alias("locs"))
    pdb = F.concat(F.lit("p"), F.lpad((k % 1000).cast("string"), 3, "0"), F.char(65 + k % 4))
    path = scratch(spark)
    lists.select(F.concat(F.lit("S"), (k % 50).cast("string")).alias("site"), pdb.alias("pdb"), "locs", k.alias("source"), F.lit('a "quoted", text').alias("desc")).write.csv(path, header=True, quote='"', escape='"')
    found = tables.read_site_list(spark, path).where(F.col("desc") == 'a "quoted", text')
    return found.select("site", "pdb", "chain", F.col("source").cast("long").alias("source"), F.size("locs").cast("long").alias("n"), F.aggregate("locs", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("source_metadata", "SELECT 'p' || s_suppkey AS pdb, s_name AS \"Description\", CAST(s_nationkey AS VARCHAR) AS \"Classification\" FROM supplier")
def source_metadata(spark, sf_dir):
    """Results written as CSV and read as metadata."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("pdb"), F.col("s_name").alias("Description"), F.col("s_nationkey").cast("string").alias("Classification"))
    path = scratch(spark)
    tables.write_results(s, path)
    return tables.read_metadata(spark, path, schema="pdb string, Description string, Classification string")


@query("source_records", f"WITH {DB_SQL} SELECT letter, id, round(e[1], 6) AS first, CAST(len(e) AS INTEGER) AS size FROM db WHERE id % 5 <> 0")
def source_records(spark, sf_dir):
    """Records by type, those without a vector left out."""
    db = site_db(spark, sf_dir).select("letter", "id", F.when(F.col("id") % 5 != 0, F.col("e")).alias("e"))
    path = scratch(spark)
    tables.write_records(db, path, required="e", partition_by=["letter"])
    back = spark.read.schema("id long, e array<double>, letter int").parquet(path)
    return back.select("letter", "id", F.round(F.element_at("e", 1), 6).alias("first"), F.size("e").alias("size"))


@query("source_id_lists", "SELECT 'c' || conv_id AS pdb, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ord, upper(role[1]) || turn AS resid FROM conversations")
def source_id_lists(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("pdb"), F.col("turn").alias("ord"), F.concat(F.upper(F.substring("role", 1, 1)), F.col("turn").cast("string")).alias("resid"))
    path = scratch(spark)
    tables.write_id_lists(c, path)
    return tables.read_id_lists(spark, path)


@query("source_fasta", "SELECT 'r' || doc_id AS id, translate(text, chr(10) || chr(13) || '>', '   ') AS seq FROM documents WHERE length(trim(text)) > 0 AND length(trim(translate(text, chr(10) || chr(13) || '>', '   '))) > 0")
def source_fasta(spark, sf_dir):
    """Whole texts as FASTA records."""
    flat = F.translate("text", "\n\r>", "   ")
    d = table(spark, sf_dir, "documents").where(F.length(F.trim(flat)) > 0).select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("id"), flat.alias("seq"))
    path = scratch(spark)
    tables.write_fasta(d, path)
    back = tables.read_fasta(spark, path).select("id", "seq")
    # A reader trims the lines of a sequence: the blanks at the ends come from the table.
    ends = d.select("id", F.col("seq").alias("whole"))
    return back.join(ends, "id").where(F.trim("whole") == F.col("seq")).select("id", F.col("whole").alias("seq"))


@query("source_features", f"""WITH {DB_SQL} SELECT pdb, CAST(row_number() OVER (PARTITION BY pdb ORDER BY id) - 1 AS INTEGER) AS ord, 'v' || id AS name, CAST(64 AS INTEGER) AS size, round(e[1], 6) AS first, round(e[64], 6) AS last FROM db""")
def source_features(spark, sf_dir):
    """One feature file for each structure: names in the header, a row for each."""
    db = site_db(spark, sf_dir)
    line = F.concat_ws("\t", F.concat(F.lit("v"), F.col("id").cast("string")), F.array_join(F.transform("e", lambda x: x.cast("string")), "\t"), F.lit("#\t0\t0\t0\t#"))
    rows = db.groupBy("pdb").agg(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))).alias("r"))
    head = F.concat(F.lit("# PDBID_LIST "), F.array_join(F.transform("r", lambda x: F.concat(F.lit("v"), x["id"].cast("string"))), ", "))
    path = scratch(spark)
    rows.select("pdb", F.concat_ws("\n", head, F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("value")).repartition("pdb").write.partitionBy("pdb").text(path)
    back = tables.read_feature_vectors(spark, f"{path}/*/*.txt")
    return back.select(F.regexp_extract("path", r"pdb=(\d+)", 1).cast("long").alias("pdb"), "ord", "name", F.size("vector").alias("size"), F.round(F.element_at("vector", 1), 6).alias("first"), F.round(F.element_at("vector", -1), 6).alias("last"))
