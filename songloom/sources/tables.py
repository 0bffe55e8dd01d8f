"""Tables that may be missing, new tables and exports for training."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from songloom.constants import NOT_SEARCHED
from songloom.functions.strings import without

LINKS_SCHEMA = T.StructType(
    [T.StructField("row_idx", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("Song Title", "Features", "Producers", "Lyrics", "Link", "Artist")]
)
LYRICS_SCHEMA = T.StructType(
    [T.StructField("row_idx", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("Artist", "Link", "Features", "Song Title", "Lyrics")]
)
BPMS_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("Rappers", "Songs", "BPM")])


def read_or_default(read: Callable[[], DataFrame], default: DataFrame) -> DataFrame:
    """The source if its path exists, else the default table. Other errors are passed on."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return default


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """Typed table without rows."""
    return spark.createDataFrame([], schema)


def with_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring a table to the schema; columns it lacks are null."""
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def initial_bpms(songs: DataFrame, artist: str | Column = "artist", title: str | Column = "title") -> DataFrame:
    """Tempo table before the first search: titles lose commas, every row is open."""
    artist = F.col(artist) if isinstance(artist, str) else artist
    return songs.select(
        artist.alias("Rappers"), without(title, ",").alias("Songs"), F.lit(NOT_SEARCHED).alias("BPM")
    )


def write_training_set(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite") -> None:
    """Write training examples as ``parquet`` or ``json`` lines."""
    df.write.mode(mode).format(form).save(path)
