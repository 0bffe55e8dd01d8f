"""The finished catalogue: songs with their tempos, sorted and written in files of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songloom.operators.joins import join_by_name, join_by_position
from songloom.operators.ordering import sort_by, with_row_index
from songloom.sources.csv import read_csv, write_csv

#: Rows of a file at most.
FILE_ROWS = 1_000_000


def merged_catalogue(songs: DataFrame, bpms: DataFrame, by: str = "name", order: str = "row_idx") -> DataFrame:
    """Songs with a column ``bpm``, by artist and title (``name``) or by row (``position``).

    By position the rows of both tables must be the same songs; a longer tempo table loses its rest, a shorter one
    leaves nulls.
    """
    plain = songs.drop("bpm")
    if by == "name":
        return join_by_name(plain, bpms, order)
    if by == "position":
        return join_by_position(plain, bpms.select(order, F.col("BPM").alias("bpm")), order)
    raise ValueError(f"neither name nor position: {by}")


def write_catalogue(merged: DataFrame, path: str, order: str = "row_idx", file_rows: int = FILE_ROWS) -> None:
    """Write the catalogue by artist and title, nulls last, equal ones in their former order.

    The sort partitions by ranges, so names of files in order and rows in files are the order of the table.
    """
    write_csv(sort_by(merged, ["artist", "title"], order), path, file_rows=file_rows)


def read_catalogue(spark: SparkSession, path: str, place: str = "place") -> DataFrame:
    """A written catalogue with each row's place in it."""
    written = read_csv(spark, path, row_order="_at")
    return with_row_index(written, ["_at"], place).drop("_at")
