"""Plain text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from songloom.functions.strings import strip
from songloom.operators.ordering import with_row_index


def read_lines(spark: SparkSession, path: str | list[str], name: str = "artist") -> DataFrame:
    """One row per line, whitespace removed at both ends."""
    return spark.read.text(path).select(strip("value").alias(name))


def read_corpus(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file: its path and its whole text in lower case, line ends as ``\\n``.

    For files that fit in memory; see ``read_corpus_lines`` for larger ones.
    """
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"),
        F.lower(_replaced("value", r"\r\n?", "\n")).alias("text"),
    )


def _replaced(text: str | Column, pattern: str, by: str) -> Column:
    """``regexp_replace`` of a pattern that needs a carriage return, for texts that have one."""
    value = F.col(text) if isinstance(text, str) else text
    return F.when(F.contains(value, F.lit("\r")), F.regexp_replace(value, pattern, by)).otherwise(value)


def read_corpus_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files of any size in rows ``path, row_idx, text``, which joined in order are the text of the file.

    Each row is a line in lower case with its line end, ready for ``corpus_windows(df, "path")``. A file is
    read in many splits. The last line has a line end only if the bytes of the lines add up to it.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("_size"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_line"),
        "value",
    )
    # One row per file, of which the scan's list of files holds more; lines go to no shuffle for it.
    ends = lines.groupBy("path").agg(
        F.max(F.struct("_split", "_line")).alias("_last"),
        (F.sum(F.octet_length("value") + 1) == F.max("_size")).alias("_ended"),
    )
    line = _replaced(_replaced("value", r"\r\z", ""), "\r", "\n")
    is_open = (F.struct("_split", "_line") == F.col("_last")) & ~F.col("_ended")
    joined = lines.join(F.broadcast(ends), "path", "left")
    # Made before rows are placed, so that it is made once for all that read them.
    whole = joined.select(
        "path", "_split", "_line", F.lower(F.concat(line, F.when(is_open, "").otherwise("\n"))).alias("text")
    )
    return with_row_index(whole, ["path", "_split", "_line"]).select("path", "row_idx", "text")
