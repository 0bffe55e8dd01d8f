"""Figures about a selection. All are plain grouped aggregates, combined on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.functions.maths import percent


def bpm_range(df: DataFrame) -> DataFrame:
    """Smallest and largest tempo; a tempo of 0 from coercion takes part."""
    return df.agg(F.min("bpm").alias("min_bpm"), F.max("bpm").alias("max_bpm"))


def songs_per_artist(df: DataFrame) -> DataFrame:
    """Number of rows per artist."""
    return df.groupBy("artist").agg(F.count("*").alias("songs"))


def selection_counts(df: DataFrame, dropped: Column, artist: str = "artist") -> DataFrame:
    """One row: rows kept, rows dropped by the condition, and different artists among those kept."""
    gone = F.coalesce(dropped, F.lit(False))
    return df.agg(
        F.count_if(~gone).alias("kept"), F.count_if(gone).alias("dropped"), F.count_distinct(F.when(~gone, F.col(artist))).alias("artists")
    )


def distinct_artists(df: DataFrame) -> DataFrame:
    """The artists that occur, sorted."""
    return df.where(F.col("artist").isNotNull()).select("artist").distinct().orderBy("artist")


def artist_count(df: DataFrame) -> DataFrame:
    """Number of different artists."""
    return distinct_per_key(df, "artist").agg(F.count("*").alias("artists"))


def distinct_per_key(df: DataFrame, column: str) -> DataFrame:
    """Different non-null values of a column, unordered."""
    return df.where(F.col(column).isNotNull()).select(column).distinct()


def summary(df: DataFrame) -> DataFrame:
    """Tempo range and song number, one row per artist and one for all (artist null) with the artist number.

    The list of artists is rows, not one array, so it may be of any length.
    """
    each = (
        df.where(F.col("artist").isNotNull())
        .groupBy("artist")
        .agg(F.min("bpm").alias("min_bpm"), F.max("bpm").alias("max_bpm"), F.count("*").alias("songs"))
    )
    total = each.agg(
        F.lit(None).cast("string").alias("artist"),
        F.min("min_bpm").alias("min_bpm"),
        F.max("max_bpm").alias("max_bpm"),
        F.sum("songs").alias("songs"),
        F.count("*").alias("artists"),
    )
    return each.withColumn("artists", F.lit(1).cast("bigint")).unionByName(total)


def progress(df: DataFrame, done: Column, by: str | None = None) -> DataFrame:
    """Rows done in percent, overall or also per value of ``by`` (null for overall)."""
    grouped = df.rollup(by) if by else df.groupBy()
    counted = grouped.agg(
        F.count_if(done).alias("done"), F.count("*").alias("total"), *([F.grouping(by).alias("_all")] if by else [])
    )
    result = counted.withColumn("percent", percent(F.col("done"), F.col("total")))
    return result.withColumn("overall", F.col("_all") == 1).drop("_all") if by else result


def first_open_position(df: DataFrame, column: str, order: str = "row_idx") -> DataFrame:
    """Smallest position whose value is not yet there; null if all are there."""
    return df.where(F.col(column).isNull()).agg(F.min(order).alias("first_open"))
