"""Steps that continue an interrupted collection, as batch functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.constants import NOT_SEARCHED, UNFINISHED
from songloom.operators.joins import worklist
from songloom.operators.ordering import append_rows, keep_first
from songloom.operators.selection import without_unfinished
from songloom.sources.tables import LYRICS_SCHEMA, with_missing_columns


def link_worklist(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Artists whose links are still to be collected."""
    return worklist(seeds, links, "Link")


def lyric_worklist(seeds: DataFrame, lyrics: DataFrame, null_is_open: bool = False) -> DataFrame:
    """Artists whose lyrics are still to be collected; ``null_is_open`` counts songs never tried as well."""
    return worklist(seeds, lyrics, "Lyrics", null_is_open=null_is_open)


def next_stage(link_work: DataFrame, lyric_work: DataFrame) -> DataFrame:
    """One row: links first, lyrics only if no link work is left."""
    counts = link_work.agg(F.count("*").alias("link_work")).withColumn(
        "lyric_work", lyric_work.agg(F.count("*")).scalar()
    )
    stage = F.when(F.col("link_work") > 0, "links").when(F.col("lyric_work") > 0, "lyrics").otherwise("done")
    return counts.withColumn("stage", stage)


def resume_links(stored: DataFrame, new: DataFrame, order: str = "row_idx") -> DataFrame:
    """Stored rows without the unfinished ones, then the new rows, first of each (Link, Artist)."""
    kept, _ = without_unfinished(stored, "Link")
    return keep_first(append_rows(kept, new, order), ["Link", "Artist"], [order])


def first_lyrics(links: DataFrame) -> DataFrame:
    """Lyric table of a first session: the collected links at their positions, all of them open.

    A link that is still unfinished has no page to read and gets no row.
    """
    collected, _ = without_unfinished(links, "Link")
    return with_missing_columns(collected.select("row_idx", "Artist", "Link"), LYRICS_SCHEMA)


def open_lyrics(stored: DataFrame, order: str = "row_idx") -> DataFrame:
    """Rows to work on: from the first one without lyrics to the end, unfinished rows left out.

    Rows keep their positions when others are dropped. There are none if no row is open.
    """
    kept, _ = without_unfinished(stored, "Lyrics")
    first = kept.where(F.col("Lyrics").isNull()).agg(F.min(order)).scalar()
    return kept.where(F.col(order) >= first)


def resume_lyrics(stored: DataFrame, results: DataFrame, order: str = "row_idx") -> DataFrame:
    """Fill results in by position, from the first open row on; other values stay."""
    kept, _ = without_unfinished(stored, "Lyrics")
    first = kept.where(F.col("Lyrics").isNull()).agg(F.min(order)).scalar()
    fields = [c for c in ("Lyrics", "Song Title", "Features") if c in results.columns]
    usable = results.where(F.col(order) >= first).select(order, *[F.col(f"`{c}`").alias(f"new {c}") for c in fields])
    joined = kept.join(usable, order, "left")
    return joined.select(
        *[F.coalesce(f"`new {c}`", f"`{c}`").alias(c) if c in fields else F.col(f"`{c}`") for c in kept.columns]
    )


def mark_failed(stored: DataFrame, failed: DataFrame, column: str, order: str = "row_idx") -> DataFrame:
    """Stored rows and, for each failed artist, a row that asks for another try."""
    marks = failed.select(F.col(order), F.col("Artist"), F.lit(UNFINISHED).alias(column))
    return append_rows(stored, marks, order)


def open_bpms(bpms: DataFrame, column: str = "BPM") -> DataFrame:
    """Rows not yet searched; a null counts as done."""
    return bpms.where(F.col(column).eqNullSafe(NOT_SEARCHED))
