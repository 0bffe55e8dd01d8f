"""Joins of songs with tempos, hits, seeds and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.constants import UNFINISHED
from songloom.functions.strings import without
from songloom.operators.equijoin import splittable_join
from songloom.operators.ordering import keep_first


def join_by_position(left: DataFrame, right: DataFrame, order: str = "row_idx") -> DataFrame:
    """Left join on the row position; both sides carry it (see ``with_row_index``)."""
    return left.join(right, order, "left")


def join_by_name(songs: DataFrame, bpms: DataFrame, order: str = "row_idx") -> DataFrame:
    """Give each song the tempo of the first row of ``bpms`` with its artist and title.

    Tempo tables write titles without commas, so commas do not count on either side. Songs of one very
    frequent name are split by adaptive execution; the other side has one row per name.
    """
    keys = ["artist", "_title"]
    named = bpms.select(order, F.col("Rappers").alias("artist"), without("Songs", ",").alias("_title"), F.col("BPM").alias("bpm"))
    tempos = keep_first(named, keys, [order]).drop(order)
    return splittable_join(songs.withColumn("_title", without("title", ",")), tempos, keys, "left").drop("_title")


def join_hits(songs: DataFrame, hits: DataFrame, how: str = "inner") -> DataFrame:
    """Each song with its search hits; ``pos`` keeps the order of the hits."""
    return songs.join(hits, "song_id", how)


def worklist(
    seeds: DataFrame,
    scraped: DataFrame,
    key_column: str,
    column: str = "artist",
    scraped_column: str = "Artist",
    null_is_open: bool = False,
) -> DataFrame:
    """Seeds still to be done: those never scraped and those with an unfinished row.

    One aggregation finds the finished artists, in place of a self anti-join.
    """
    open_row = F.col(key_column).eqNullSafe(UNFINISHED)
    if null_is_open:
        open_row = open_row | F.col(key_column).isNull()
    finished = (
        scraped.groupBy(F.col(scraped_column).alias(column)).agg(F.max(open_row).alias("_open")).where(~F.col("_open"))
    )
    return seeds.select(column).distinct().join(finished, column, "left_anti")


def songs_of_selected(songs: DataFrame, selected: DataFrame, column: str = "artist") -> DataFrame:
    """Songs whose artist is in the table of selected artists."""
    return splittable_join(songs, selected.select(column).distinct(), [column], "left_semi")


def song_counts_of_selected(songs: DataFrame, selected: DataFrame) -> DataFrame:
    """Number of songs per selected artist; selecting an artist twice changes nothing."""
    counts = songs.groupBy("artist").agg(F.count("*").alias("songs"))
    return (
        selected.select("artist").distinct().join(counts, "artist", "left")
        .select("artist", F.coalesce("songs", F.lit(0)).alias("songs"))
    )
