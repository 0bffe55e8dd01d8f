"""Selecting a slice of the catalogue by section, artist and tempo.

The catalogue is wide (one text column per song section) or long (columns ``section`` and ``text``).
In the long form the choice of a section is a filter, which reaches the scan of a table partitioned
by ``section``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from songloom.constants import BOOKMARKED, NON_SECTION_COLUMNS, UNFINISHED
from songloom.functions.coercion import bpm_number
from songloom.operators.equijoin import splittable_join


def section_columns(wide: DataFrame, others: Iterable[str] = NON_SECTION_COLUMNS) -> list[str]:
    """Columns of a wide catalogue that hold a song section."""
    others = set(others)
    return [c for c in wide.columns if c not in others]


def unpivot_sections(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Wide catalogue to long form; a section a song does not have gives no row."""
    return wide.unpivot(keys, section_columns(wide, keys), "section", "text").where(F.col("text").isNotNull())


def of_section(long: DataFrame, section: str) -> DataFrame:
    """Rows of one section, tempo coerced to BIGINT."""
    chosen = long.where((F.col("section") == section) & F.col("text").isNotNull())
    return chosen.withColumn("bpm", bpm_number("bpm"))


def of_section_wide(wide: DataFrame, section: str) -> DataFrame:
    """Rows of a wide catalogue that have the section, tempo coerced to BIGINT.

    Of the sections only this one is read, where unpivoting first would read all of them.
    """
    return wide.where(F.col(f"`{section}`").isNotNull()).withColumn("bpm", bpm_number("bpm"))


def long_of_section(wide: DataFrame, section: str, keys: Iterable[str] = ("artist", "title")) -> DataFrame:
    """As unpivoting and ``of_section`` give it, but the other sections are never read and no row is multiplied."""
    return of_section_wide(wide, section).select(*keys, "bpm", F.lit(section).alias("section"), F.col(f"`{section}`").alias("text"))


def of_artists(df: DataFrame, artists: Iterable[str] | DataFrame, column: str = "artist") -> DataFrame:
    """Rows of the selected artists, given as a list or as a table with that column."""
    if isinstance(artists, DataFrame):
        return splittable_join(df, artists.select(column).distinct(), [column], "left_semi")
    return df.where(F.col(column).isin(list(artists)))


def in_bpm_range(df: DataFrame, low: int | Column, high: int | Column) -> DataFrame:
    """Rows whose tempo lies in the range, both ends included."""
    return df.where(F.col("bpm").between(low, high))


def of_artists_in_range(df: DataFrame, artists: Iterable[str] | DataFrame, low: int, high: int) -> DataFrame:
    """Rows of the artists within the tempo range; the range is checked against these artists."""
    chosen = of_artists(df, artists)
    check_range(chosen, low, high)
    return in_bpm_range(chosen, low, high)


def with_known_bpm(df: DataFrame, raw: str = "bpm") -> DataFrame:
    """Rows whose tempo text is neither the no-match marker nor 0; nulls stay and become 0."""
    known = df.where(~F.coalesce(F.col(raw).isin(BOOKMARKED, "0"), F.lit(False)))
    return known.withColumn("bpm", bpm_number(raw))


def with_marker(df: DataFrame, column: str, marker: str) -> DataFrame:
    """Rows that carry a state marker."""
    return df.where(F.col(column) == marker)


def without_unfinished(df: DataFrame, column: str, marker: str = UNFINISHED) -> tuple[DataFrame, Observation]:
    """Rows without the marker, and an observation ``dropped`` filled when the result is computed."""
    observation = Observation()
    marked = F.col(column).eqNullSafe(marker)
    seen = df.observe(observation, F.count_if(marked).alias("dropped"))
    return seen.where(~marked), observation


def from_position(df: DataFrame, start: int | Column, order: str = "row_idx") -> DataFrame:
    """Rows at and after a position."""
    return df.where(F.col(order) >= start)


def missing_values(requested: DataFrame, available: DataFrame, column: str) -> DataFrame:
    """Requested values that do not occur in the data."""
    return requested.select(column).distinct().join(available.select(column).distinct(), column, "left_anti")


def check_section(long: DataFrame, section: str) -> None:
    """Raise if the section does not occur."""
    if long.where((F.col("section") == section) & F.col("text").isNotNull()).isEmpty():
        raise ValueError(f"no such section: {section}")


def check_artists(df: DataFrame, artists: Iterable[str]) -> None:
    """Raise if an artist does not occur in the selection."""
    wanted = set(artists)
    found = {r[0] for r in df.where(F.col("artist").isin(list(wanted))).select("artist").distinct().collect()}
    if wanted - found:
        raise ValueError(f"no such artists: {sorted(wanted - found)}")


def check_range(df: DataFrame, low: int, high: int) -> None:
    """Raise if an end of the range lies outside the tempos of the selection."""
    bounds = df.agg(F.min("bpm").alias("low"), F.max("bpm").alias("high")).first()
    for end in (low, high):
        if bounds.low is None or not bounds.low <= end <= bounds.high:
            raise ValueError(f"{end} lies outside the tempos {bounds.low} to {bounds.high}")


def domain_findings(chosen: DataFrame, artists: Iterable[str] = (), bpm_range: tuple[int, int] | None = None) -> DataFrame:
    """One row on a selection: ``n`` rows, the artists asked for that are ``missing``, and the tempos of those there.

    The range is checked against the rows of the artists asked for (of all, if none are named). What the row holds is
    bound by the number of artists asked for.
    """
    wanted = sorted(set(artists))
    asked = F.array(*map(F.lit, wanted)).cast("array<string>")
    mine = F.col("artist").isin(wanted) if wanted else F.lit(True)
    found = chosen.agg(
        F.count("*").alias("n"),
        F.array_sort(F.array_except(asked, F.collect_set(F.when(mine & F.lit(bool(wanted)), F.col("artist"))))).alias("missing"),
        F.min(F.when(mine, F.col("bpm"))).alias("min_bpm"),
        F.max(F.when(mine, F.col("bpm"))).alias("max_bpm"),
    )
    low, high = bpm_range if bpm_range is not None else (None, None)
    inside = lambda end: F.coalesce(F.lit(end).between(F.col("min_bpm"), F.col("max_bpm")), F.lit(False)) if end is not None else F.lit(True)
    return found.select("*", inside(low).alias("low_ok"), inside(high).alias("high_ok"))


def checked(chosen: DataFrame, artists: Iterable[str] = (), bpm_range: tuple[int, int] | None = None) -> DataFrame:
    """The same rows in a plan that fails when it is run on a selection without rows, an artist or an end of the range.

    All checks are one aggregate inside the plan; no job runs before it, and nothing is brought to the driver.
    """
    found = domain_findings(chosen, artists, bpm_range)
    wrong = (
        F.when(F.col("n") == 0, F.lit("no rows of that section"))
        .when(F.size("missing") > 0, F.concat(F.lit("no such artists: "), F.array_join("missing", ", ")))
        .when(~(F.col("low_ok") & F.col("high_ok")), F.concat(
            F.lit("range outside the tempos "), F.coalesce(F.concat_ws(" to ", "min_bpm", "max_bpm"), F.lit("of no rows"))
        ))
    )
    passed = found.select(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(F.lit(True)).alias("passed"))
    return chosen.where(passed.scalar())


def checked_slice(
    wide: DataFrame, section: str, artists: Iterable[str] = (), bpm_range: tuple[int, int] | None = None, keys: Iterable[str] = ("artist", "title")
) -> DataFrame:
    """Selection by artist, by tempo or by both from a wide catalogue; wrong parameters fail the plan (see ``checked``)."""
    if section not in section_columns(wide, {*NON_SECTION_COLUMNS, *keys}):
        raise ValueError(f"no such section: {section}")
    artists = list(artists)
    chosen = checked(long_of_section(wide, section, keys), artists, bpm_range)
    chosen = of_artists(chosen, artists) if artists else chosen
    return in_bpm_range(chosen, *bpm_range) if bpm_range is not None else chosen


def select_slice(
    catalogue: DataFrame,
    section: str,
    artists: Iterable[str] | None = None,
    bpm_range: tuple[int, int] | None = None,
    known_only: bool = False,
) -> DataFrame:
    """Selection by artist, by tempo or by both, with its parameters checked first.

    The catalogue may be long or wide; the result is long.
    """
    if "section" in catalogue.columns:
        check_section(catalogue, section)
        chosen = of_section(with_known_bpm(catalogue) if known_only else catalogue, section)
    else:
        sections = section_columns(catalogue)
        if section not in sections:
            raise ValueError(f"no such section: {section}")
        chosen = of_section_wide(with_known_bpm(catalogue) if known_only else catalogue, section)
        chosen = chosen.select("artist", "title", "bpm", F.lit(section).alias("section"), F.col(f"`{section}`").alias("text"))
    if artists is not None:
        artists = list(artists)
        check_artists(chosen, artists)
        chosen = of_artists(chosen, artists)
    if bpm_range is not None:
        check_range(chosen, *bpm_range)
        chosen = in_bpm_range(chosen, *bpm_range)
    return chosen
