"""A stream of new structure files into the atom table.

An addition for operation: each micro-batch parses the files that have arrived
and appends their atoms. A batch that is repeated after a failure overwrites its
own folder, so files are taken in once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.structures import atoms_of

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_structures(spark: SparkSession, source: str, target: str, checkpoint: str, glob: str = "*", once: bool = True, files_per_batch: int = 1000) -> StreamingQuery:
    """Start the stream; with ``once`` it ends when all present files are in."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(source)

    def append(batch: DataFrame, batch_id: int) -> None:
        atoms_of(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
