"""The engine's tables, derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songloom.constants import BOOKMARKED, NOT_SEARCHED, UNFINISHED
from songloom.functions.markup import Node
from songloom.operators.corpus import next_char_distribution
from songloom.operators.selection import unpivot_sections
from songloom.session import spread

SECTIONS = ("en", "fr", "de", "es")

# Where the given pages hold what song pages hold in the default nodes.
PAGE_NODES = (Node("lyrics", "article"), Node("title", "h1"), Node("info", "article"), Node("features", "b", within="info"))
LIST_ITEM = Node("hit", "li")
LIST_NODES = (Node("artist_name", "a"), Node("song_name", "a"), Node("bpm", "a"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def spread_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents for work that multiplies rows, on all cores even if the table is one file."""
    return spread(documents(spark, sf_dir).select(*columns))


def catalogue_wide(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """Wide catalogue: a document is a song, its source the artist, its language the section it has."""
    source = documents(spark, sf_dir) if source is None else source
    number = (60 + F.col("n_chars") % 140).cast("string")
    case = F.col("doc_id") % 5
    bpm = (
        F.when(case == 0, BOOKMARKED).when(case == 1, NOT_SEARCHED).when(case == 2, F.lit(None).cast("string"))
        .when(case == 3, F.concat(number, F.lit(".7"))).otherwise(number)
    )
    return source.select(
        F.col("doc_id").alias("row_idx"),
        F.col("source").alias("artist"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"),
        bpm.alias("bpm"),
        *[F.when(F.col("lang") == s, F.col("text")).alias(s) for s in SECTIONS],
    )


def catalogue(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """Long catalogue."""
    return unpivot_sections(catalogue_wide(spark, sf_dir, source), ["row_idx", "artist", "title", "bpm"])


def spread_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long catalogue for work that is heavy per text."""
    return catalogue(spark, sf_dir, spread(documents(spark, sf_dir)))


def bpms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tempo table of the catalogue, with every row twice."""
    once = catalogue_wide(spark, sf_dir).select("row_idx", F.col("artist").alias("Rappers"), F.col("title").alias("Songs"), F.col("bpm").alias("BPM"))
    again = once.select((F.col("row_idx") + F.lit(10**12)).alias("row_idx"), "Rappers", "Songs", F.lit("1").alias("BPM"))
    return once.unionByName(again)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link table: an event is a collected link of a user, an error an unfinished artist."""
    link = F.when(F.col("event_type") == "error", UNFINISHED).otherwise(F.concat(F.lit("https://x/"), F.col("event_type")))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_idx"), link.alias("Link"), F.col("user_id").cast("string").alias("Artist")
    )


def lyrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lyric table: labelled documents have been collected, bad ones are unfinished."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    value = F.when(F.col("quality") == 0, UNFINISHED).when(F.col("quality") == 1, F.col("text"))
    return documents(spark, sf_dir).join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_idx"), F.col("source").alias("Artist"), value.alias("Lyrics")
    )


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("artist"))


def scraped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as collected seeds; bad ones are unfinished."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("Artist"),
        F.when(F.col("quality") == 0, UNFINISHED).otherwise("ok").alias("Link"),
    )


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("song_id"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title")
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the tempo site: parts with artist and title written in several ways."""
    blank = F.lit(" ")
    by = F.col("p_size") % 3
    form = F.col("p_size") % 4
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(by == 0, F.col("p_brand")).when(by == 1, F.col("p_type"))
        .otherwise(F.concat("p_brand", blank, "p_type")).alias("artist_name"),
        F.when(form == 0, F.col("p_name")).when(form == 1, F.concat("p_name", F.lit(" remix")))
        .when(form == 2, F.concat("p_type", blank, "p_name"))
        .otherwise(F.concat("p_name", F.lit(" feat "), "p_brand")).alias("song_name"),
        F.when(F.col("p_size") == 13, "n/a").otherwise((60 + F.col("p_size")).cast("string")).alias("bpm"),
    )


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn right after it, met by number: one long talk is no hot group."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(answered, ["conv_id", "turn"])


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, some without the node that holds the features."""
    html = F.when(F.col("page_id") % 10 == 0, F.replace("html", F.lit("<b>"), F.lit(""))).otherwise(F.col("html"))
    return spread(table(spark, sf_dir, "pages")).select("page_id", "url", html.alias("html"))


def relative_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose links are written relative to the page, in a way that depends on the page."""
    ways = ['<a href="', '<a href="..', '<a title="href=no" HREF="?p=2&amp;to=', "<a href='#t' href=\"", '<a href=" ./.']
    html = F.lit(None).cast("string")
    for rest, way in enumerate(ways):
        html = F.when(F.col("page_id") % len(ways) == rest, F.replace("html", F.lit('<a href="'), F.lit(way))).otherwise(html)
    return spread(table(spark, sf_dir, "pages")).select("page_id", "url", html.alias("html"))


def page_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header text of a page: its number of list items, one too many on some pages."""
    items = F.size(F.regexp_extract_all("html", F.lit("<li>"), F.lit(0)))
    extra = F.when(F.col("page_id") % 10 == 0, 1).otherwise(0)
    return table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit(" "), (items + extra).cast("string"), F.lit(" Songs")).alias("header")
    )


def next_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_char_distribution(spread_documents(spark, sf_dir, "text"))
