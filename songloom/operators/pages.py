"""Crawled pages to tables: song fields, links, result counts and tempo search hits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from songloom.constants import (
    FEATURES_CLASS,
    HIT_ARTIST_CLASS,
    HIT_BPM_CLASS,
    HIT_CLASS,
    HIT_TITLE_CLASS,
    INFO_CLASS,
    LYRICS_CLASS,
    SONG_LINK_CLASS,
    TITLE_CLASS,
    UNSCRAPABLE,
)
from songloom.functions.addresses import resolved, tidied
from songloom.functions.markup import Node, anchors, node_texts
from songloom.functions.strings import first_token_int, strip

SONG_PAGE = (
    Node("lyrics", "div", LYRICS_CLASS),
    Node("title", "h1", TITLE_CLASS),
    Node("info", "div", INFO_CLASS),
    Node("features", "span", FEATURES_CLASS, within="info"),
)
HIT = Node("hit", "a", HIT_CLASS, exact=True)
HIT_NODES = (
    Node("artist_name", "p", HIT_ARTIST_CLASS, exact=True),
    Node("song_name", "p", HIT_TITLE_CLASS, exact=True),
    Node("bpm", "p", HIT_BPM_CLASS, exact=True, nth=1),
)


def _texts(html: Column, nodes: tuple[Node, ...], names: list[str], each: Node | None = None) -> Column:
    """Array of one struct of texts per record. Only the page text goes to the Python worker."""
    kind = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))

    @F.pandas_udf(kind)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(lambda page: [{n: r.get(n) for n in names} for r in node_texts(page, nodes, each)])

    return read(html)


def page_fields(pages: DataFrame, nodes: tuple[Node, ...] = SONG_PAGE) -> DataFrame:
    """Lyrics, title and features per page; ``features`` is looked up inside the info block.

    If any of the three is missing, lyrics carry the marker for pages that cannot be used and the others
    are null; ``status`` says so too.
    """
    names = ["lyrics", "title", "features"]
    found = pages.withColumn("_found", F.get(_texts(F.col("html"), nodes, names), F.lit(0)))
    complete = F.lit(True)
    for name in names:
        complete = complete & F.col(f"_found.{name}").isNotNull()
    complete = F.coalesce(complete, F.lit(False))
    return found.select(
        *[c for c in pages.columns if c != "html"],
        F.when(complete, F.col("_found.lyrics")).otherwise(UNSCRAPABLE).alias("lyrics"),
        F.when(complete, F.col("_found.title")).alias("title"),
        F.when(complete, F.col("_found.features")).alias("features"),
        F.when(complete, "ok").otherwise(UNSCRAPABLE).alias("status"),
    )


def search_page_hits(
    pages: DataFrame, each: Node = HIT, nodes: tuple[Node, ...] = HIT_NODES, key: str = "page_id"
) -> DataFrame:
    """Hits of search pages in page order: artist and title in lower case, tempo as text."""
    names = ["artist_name", "song_name", "bpm"]
    found = pages.select(key, F.posexplode(_texts(F.col("html"), nodes, names, each)).alias("pos", "hit"))
    shown = lambda name: strip(F.regexp_replace(F.col(f"hit.{name}"), r"\s+", " "))
    return found.select(
        key,
        "pos",
        F.lower(shown("artist_name")).alias("artist_name"),
        F.lower(shown("song_name")).alias("song_name"),
        shown("bpm").alias("bpm"),
    )


def page_links(
    pages: DataFrame, anchor_class: str | None = SONG_LINK_CLASS, keys: tuple[str, ...] = ("page_id",), resolve: bool = False
) -> DataFrame:
    """Different link targets per page, of anchors whose class attribute equals ``anchor_class`` (any if None).

    ``resolve`` makes targets absolute against the base address that the page names, or its ``url``.
    """

    @F.pandas_udf("base string, targets array<string>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for htmls in batches:
            yield pd.DataFrame([anchors(html, anchor_class) for html in htmls], columns=["base", "targets"])

    found = pages.select(*keys, *(["url"] if resolve else []), read("html").alias("_found"))
    if not resolve:
        return found.select(*keys, F.explode("_found.targets").alias("href")).distinct()
    base = F.coalesce(resolved(tidied(F.col("_found.base")), F.col("url")), F.col("url"))
    links = found.select(*keys, base.alias("_base"), F.explode("_found.targets").alias("href"))
    links = links.select(*keys, resolved(tidied(F.col("href")), F.col("_base")).alias("href"))
    return links.where(F.col("href").isNotNull()).distinct()


def link_completeness(headers: DataFrame, links: DataFrame, header: str = "header", key: str = "page_id") -> DataFrame:
    """Links found per page against the number its header text begins with."""
    counts = links.groupBy(key).agg(F.count("*").alias("found"))
    return headers.join(counts, key, "left").select(
        key,
        first_token_int(header).alias("expected"),
        F.coalesce("found", F.lit(0)).alias("found"),
        F.coalesce(F.coalesce("found", F.lit(0)) >= first_token_int(header), F.lit(False)).alias("complete"),
    )
