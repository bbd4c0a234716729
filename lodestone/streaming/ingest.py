"""Files that arrive in a folder, as a stream of records kept in a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.index import KEY, newest
from lodestone.sources.files import RECORD, listing, records

FILE = "path string, modificationTime timestamp, length long, content binary"


def follow(spark: SparkSession, root: str, kb_id: str, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Reads each new file under root once and appends its record to a Parquet table, with the batch it came in.

    A batch writes a folder of its own name and replaces it if it is run again after a failure, so no record
    comes twice. Deletions aren't events of a folder; see index.keep_only for these."""
    source = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").load(root)

    def put(batch: DataFrame, number: int) -> None:
        records(listing(batch, root, kb_id)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The latest record of each document of a table that follow() writes."""
    rows = spark.read.schema(f"{RECORD}, batch long").parquet(table)
    return newest(rows, KEY, [F.desc("batch"), F.desc("mtime")]).drop("batch")
