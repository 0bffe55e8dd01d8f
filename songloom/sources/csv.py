"""CSV files with a header and quoted fields that may hold line breaks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from songloom.functions.coercion import null_tokens

_FORMAT = {"header": "true", "quote": '"', "escape": '"'}


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    tokens: Iterable[str] = ("",),
    row_order: str | None = None,
) -> DataFrame:
    """Read CSV without type inference: columns are text unless a schema says otherwise.

    ``row_order`` adds a column to sort by, file name and then place in the file; ``with_row_index`` makes
    positions of it. A file with line breaks inside fields is one task, so keep large exports in many files.
    """
    reader = spark.read.options(**_FORMAT, multiLine="true", inferSchema="false")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    if row_order:
        place = F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id().alias("place"))
        df = df.select("*", place.alias(row_order))
    return null_tokens(df, tokens)


def read_csv_indexed(spark: SparkSession, path: str | list[str], index: str = "row_idx") -> DataFrame:
    """Read CSV whose nameless first column is the row position; all other columns are text."""
    df = read_csv(spark, path)
    first, *rest = df.columns
    return df.select(F.col(f"`{first}`").try_cast("bigint").alias(index), *[F.col(f"`{c}`") for c in rest])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", file_rows: int = 0) -> None:
    """Write CSV without a position column, each partition to its own file, or to files of at most ``file_rows`` rows."""
    df.write.mode(mode).options(**_FORMAT, quoteAll="true", nullValue="", emptyValue="", maxRecordsPerFile=file_rows).csv(path)


def write_csv_indexed(df: DataFrame, path: str, index: str = "row_idx", mode: str = "overwrite") -> None:
    """Write CSV with the row position as first column."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != index]
    write_csv(df.select(F.col(index), *rest), path, mode)
