"""Helpers that the corpus operators share: tables, materialisation, workers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks: what ends a word in the contracts of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"

written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, from ``spark.checkpoint.dir``.

    Only where that is unset and the master is local, as in tests, a temporary
    folder takes its place; on a cluster executors could not share it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='sitewise-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, by: str | None = None, buckets: int = 0) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs later steps only their own
    tasks. The files go when the driver ends. With ``by`` the table has
    ``buckets`` of that column, so that joins on it don't shuffle it again; its
    rows are to be partitioned likewise, or each task writes a file a bucket.
    """
    spark = df.sparkSession
    name = f"table_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    # Texts and hashes hardly repeat, so dictionaries would be built in vain.
    if by is None:
        df.write.option("parquet.enable.dictionary", "false").parquet(path)
        written.append((spark, path))
        return spark.read.schema(df.schema).parquet(path)
    df.write.bucketBy(buckets, by).option("parquet.enable.dictionary", "false").option("path", path).format("parquet").saveAsTable(name)
    written.append((spark, path))
    return spark.table(name)


def bucket_count(rows: int) -> int:
    """Buckets of a table of so many rows: about 100,000 rows each, 65,536 at most."""
    return min(max(8, rows // 100_000), 1 << 16)


def numbered(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Columns _row (a row of ``docs``), _id and _rid, a number of the row's own.

    The rows are written once, so a row keeps its number however often it is read.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return materialize(docs.select(row, F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_rid")))


def row_order(*more: str) -> Column:
    """The order of numbered rows: by id, those without one last, then by number."""
    return F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_rid").alias("rid"), *more)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores before it as make it no column's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def discard(df: DataFrame) -> None:
    """Remove the files of a materialised table that nothing will read again."""
    files = df.inputFiles()
    if files:
        parent = files[0].rsplit("/", 1)[0]
        for entry in list(written):
            if parent.endswith(entry[1].rsplit("/", 1)[1]):
                _remove(*entry)
                written.remove(entry)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        name = path.rsplit("/", 1)[1]
        if spark.catalog.tableExists(name):
            spark.sql(f"DROP TABLE {name}")
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended already
        pass


@atexit.register
def _cleanup() -> None:
    for entry in written:
        _remove(*entry)


def crc_fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null ids take fold 0 of ''."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def batches_of(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of items whose sizes add up to about ``most`` each."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


def hashed_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """``most`` rows at most, by a hash of the key: those with the smallest.

    Rows beyond twice that share of the hashes are dropped where they are read,
    so what meets in one task to be ordered is bounded whatever the input.
    """
    span, total = 1 << 40, df.count()
    bound = span if total <= 2 * most else min(span, int(span * (2 * most + 64) / total))
    placed = df.withColumn("_h", F.pmod(F.xxhash64(key), F.lit(span))).where(F.col("_h") < bound)
    return placed.orderBy("_h", key).limit(most).drop("_h")
