"""The same steps on streams of files, in micro-batches with exactly-once results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from songloom.constants import UNFINISHED
from songloom.operators.equijoin import free_name
from songloom.operators.ordering import keep_first

#: Bytes of new files that one micro-batch takes in before its rows are saved.
BATCH_BYTES = 1 << 30


def link_stream(
    spark: SparkSession, path: str, schema: T.StructType, bytes_per_batch: int = BATCH_BYTES, only: str = "*"
) -> DataFrame:
    """Parquet files of new rows in a folder as a stream; ``only`` is a pattern of file names.

    Files are taken in by their time of change, as many per micro-batch as fit ``bytes_per_batch`` (one at least):
    many small files are one batch, and a backlog is saved every so many bytes.
    """
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).option("latestFirst", "false")
    return reader.option("pathGlobFilter", only).parquet(path)


def collect_links(stream: DataFrame, table: str, checkpoint: str, order: str = "row_idx") -> None:
    """Take in all rows there are and save after every micro-batch.

    Each micro-batch writes its own folder, first of each (Link, Artist) only, and overwrites it when it
    is run again after a failure. Stored rows are never rewritten.
    """

    def save(batch: DataFrame, number: int) -> None:
        first = keep_first(batch, ["Link", "Artist"], [order])
        first.write.mode("overwrite").parquet(f"{table}/batch_id={number}")

    stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def collected_links(spark: SparkSession, table: str, order: str = "row_idx", unfinished: bool = False) -> DataFrame:
    """The table as it stands: first of each (Link, Artist), earlier micro-batches first.

    Marks of failed artists are left out as at the start of the next run, or kept if ``unfinished``.
    """
    rows = spark.read.parquet(table)
    if not unfinished:
        rows = rows.where(~F.col("Link").eqNullSafe(UNFINISHED))
    return keep_first(rows, ["Link", "Artist"], ["batch_id", order]).drop("batch_id")


def distinct_links(stream: DataFrame, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Stream with each (Link, Artist) once.

    Without event time the state keeps every key ever seen; with it, keys are forgotten after ``delay``.
    """
    keys = ["Link", "Artist"]
    if event_time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def collect_distinct(stream: DataFrame, table: str, checkpoint: str, keys: list[str]) -> None:
    """Append each new key to a table, in one folder per micro-batch, with no state in the stream.

    What is known already is what the folders of earlier micro-batches hold, so a copy may come at any time later and
    is dropped, and memory does not grow with the keys seen. A batch is made different first and then meets the keys of the
    table once; large batches (``bytes_per_batch``) keep these meetings few. A batch that is run again after a failure
    looks at earlier folders alone and overwrites its own. Null keys are keys like any other.
    """

    def save(batch: DataFrame, number: int) -> None:
        new = batch.select(*keys).distinct()
        if number:
            name = free_name("_key", new)
            known = batch.sparkSession.read.parquet(table).where(F.col("batch_id") < number).select(F.struct(*keys).alias(name))
            new = new.withColumn(name, F.struct(*keys)).join(known, name, "left_anti").drop(name)
        new.write.mode("overwrite").parquet(f"{table}/batch_id={number}")

    stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def run_to_table(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Process all rows there are and append the result to a Parquet table."""
    stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode(
        "append"
    ).trigger(availableNow=True).start().awaitTermination()


def compact_links(spark: SparkSession, table: str, target: str, order: str = "row_idx") -> None:
    """Write the table as it stands to a new folder, in few large files."""
    collected_links(spark, table, order).write.mode("errorifexists").parquet(target)
