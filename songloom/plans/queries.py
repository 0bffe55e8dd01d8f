"""One query per operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songloom.constants import NOT_SEARCHED, UNFINISHED
from songloom.functions import coercion, maths, strings
from songloom.operators import aggregates as agg
from songloom.operators import blocking, corpus, joins, matching, merging, ordering, sampling, selection
from songloom.operators import pages as web
from songloom.plans import views
from songloom.session import new_dir, stored
from songloom.sources import csv, tables, text
from songloom.streaming import incremental, resume

#: Rows per file of a corpus that is written.
CORPUS_FILE_ROWS = 8192

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# Sources and sinks


@query
def src_csv(spark, sf_dir):
    path = new_dir(spark, "csv")
    csv.write_csv(views.conversation_pairs(spark, sf_dir), path)
    return csv.read_csv(spark, path).select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "question", "answer"
    )


@query
def src_csv_idx(spark, sf_dir):
    path = new_dir(spark, "csv")
    csv.write_csv(views.links(spark, sf_dir).select(F.col("row_idx").alias("_c0"), "Link", "Artist"), path)
    return csv.read_csv_indexed(spark, path)


@query
def src_lines(spark, sf_dir):
    path = new_dir(spark, "lines")
    views.songs(spark, sf_dir).select(F.concat(F.lit(" \t"), "title", F.lit("  "))).write.text(path)
    return text.read_lines(spark, path).groupBy("artist").agg(F.count("*").alias("n"))


@query
def src_corpus(spark, sf_dir):
    path = new_dir(spark, "corpus")
    # An artist's corpus is a folder of files that each fit in memory.
    views.spread_documents(spark, sf_dir, "source", F.replace("text", F.lit("\n"), F.lit(" ")).alias("value")).write.option(
        "maxRecordsPerFile", CORPUS_FILE_ROWS
    ).partitionBy("source").text(path)
    artist = F.regexp_extract("path", "source=([^/]*)", 1)
    lines = text.read_corpus_lines(spark, path).withColumn("artist", artist)
    windows = corpus.corpus_windows(lines, "artist").groupBy("artist").agg(F.count("*").alias("windows"))
    whole = text.read_corpus(spark, path).groupBy(artist.alias("artist")).agg(F.sum(F.length("text")).alias("chars"))
    return whole.join(windows, "artist").select("artist", "chars", "windows")


@query
def src_default(spark, sf_dir):
    default = tables.empty_table(spark, tables.BPMS_SCHEMA)
    found = tables.read_or_default(lambda: spark.read.parquet(f"{sf_dir}/no-such-table.parquet"), default)
    return found.unionByName(tables.initial_bpms(views.songs(spark, sf_dir)), allowMissingColumns=True)


@query
def src_seed_nulls(spark, sf_dir):
    return tables.with_missing_columns(views.links(spark, sf_dir), tables.LINKS_SCHEMA)


@query
def src_bpm_init(spark, sf_dir):
    titled = views.songs(spark, sf_dir).withColumn("title", F.replace("title", F.lit(" "), F.lit(", ")))
    return tables.initial_bpms(titled)


@query
def snk_csv(spark, sf_dir):
    path = new_dir(spark, "csv")
    csv.write_csv(views.catalogue_wide(spark, sf_dir), path)
    return csv.read_csv(spark, path).withColumn("row_idx", F.col("row_idx").cast("bigint"))


@query
def snk_csv_idx(spark, sf_dir):
    path = new_dir(spark, "csv")
    csv.write_csv_indexed(views.catalogue(spark, sf_dir).select("artist", "section", "text", "row_idx"), path)
    return csv.read_csv_indexed(spark, path)


@query
def snk_trainset(spark, sf_dir):
    path = new_dir(spark, "training")
    tables.write_training_set(corpus.training_examples(corpus.prompts(views.catalogue(spark, sf_dir))), path, "json")
    return spark.read.schema("text string").json(path)


# Projection, filter, predicates


@query
def prj_sections(spark, sf_dir):
    return views.catalogue(spark, sf_dir).select("section").distinct()


@query
def prj_unpivot(spark, sf_dir):
    return views.catalogue(spark, sf_dir)


@query
def flt_section(spark, sf_dir):
    return _english(spark, sf_dir).select("row_idx", "artist", "title", "bpm", "text")


@query
def prj_select(spark, sf_dir):
    return selection.of_section_wide(views.catalogue_wide(spark, sf_dir), "fr").select("artist", "title", "bpm", "fr")


@query
def flt_artists(spark, sf_dir):
    chosen = _english(spark, sf_dir)
    return selection.of_artists(chosen, ["src1", "src7", "src1"]).select("row_idx", "artist", "title", "text")


@query
def flt_bpm_range(spark, sf_dir):
    chosen = _english(spark, sf_dir)
    return selection.in_bpm_range(chosen, 90, 150).select("row_idx", "artist", "title", "bpm", "text")


@query
def flt_both(spark, sf_dir):
    """The lower half of the tempo range the two artists have."""
    chosen = selection.of_artists(_english(spark, sf_dir), ["src1", "src7"])
    bounds = agg.bpm_range(chosen)
    low = bounds.select("min_bpm").scalar()
    middle = bounds.select(((F.col("min_bpm") + F.col("max_bpm")) / 2).cast("bigint")).scalar()
    return selection.in_bpm_range(chosen, low, middle).select("row_idx", "artist", "title", "bpm", "text")


@query
def flt_slice(spark, sf_dir):
    """A slice by artists and tempo whose parameters the plan itself checks."""
    wide = views.catalogue_wide(spark, sf_dir)
    return selection.checked_slice(wide, "en", ["src1", "src3", "src5", "src7"], (0, 100), ["row_idx", "artist", "title"])


@query
def chk_slice(spark, sf_dir):
    """What the checks find on parameters of which some are wrong."""
    found = selection.domain_findings(_english(spark, sf_dir), ["src1", "nobody", "src7", "no one"], (0, 1_000_000))
    return found.withColumn("missing", F.array_join("missing", ","))


@query
def flt_bpm_known(spark, sf_dir):
    return selection.with_known_bpm(views.catalogue(spark, sf_dir)).select("row_idx", "section", "bpm")


@query
def flt_sentinel(spark, sf_dir):
    return selection.with_marker(views.links(spark, sf_dir), "Link", UNFINISHED)


@query
def flt_drop_unfinished(spark, sf_dir):
    kept, _ = selection.without_unfinished(views.lyrics(spark, sf_dir), "Lyrics")
    return kept


@query
def flt_suffix(spark, sf_dir):
    lyrics = views.lyrics(spark, sf_dir)
    return selection.from_position(lyrics, agg.first_open_position(lyrics, "Lyrics").scalar()).select("row_idx", "Artist")


@query
def chk_domain(spark, sf_dir):
    """Users of the event table that are asked for as customers but do not exist, and the reverse."""
    users = views.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("artist"))
    customers = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("artist"))
    return selection.missing_values(customers, users, "artist")


# Type coercion


@query
def cst_bpm(spark, sf_dir):
    return views.catalogue_wide(spark, sf_dir).select("row_idx", coercion.bpm_number("bpm").alias("bpm"))


@query
def cst_str(spark, sf_dir):
    wide = views.catalogue_wide(spark, sf_dir)
    return wide.select(*[coercion.as_text(c).alias(c) for c in wide.columns])


@query
def cst_int(spark, sf_dir):
    number = coercion.strict_int("bpm")
    return views.entries(spark, sf_dir).select(
        "id", number.alias("bpm"), F.when(number.isNull(), "INVALID_BPM").otherwise("ok").alias("status")
    )


# Joins and lookups


def _left_right(spark, sf_dir):
    customer = views.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    supplier = views.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return (
        ordering.with_row_index(customer, ["c_name", "c_custkey"], descending=["c_name"]),
        ordering.with_row_index(supplier, ["s_name", "s_suppkey"], descending=["s_name"]),
    )


@query
def join_position(spark, sf_dir):
    return joins.join_by_position(*_left_right(spark, sf_dir))


@query
def join_keyed(spark, sf_dir):
    return joins.join_by_name(
        views.catalogue_wide(spark, sf_dir).select("row_idx", "artist", "title"), views.bpms(spark, sf_dir)
    )


#: Hits that a page of the search shows; only what asks for a page is cut at it.
PAGE_SIZE = 10


def _hits(spark, sf_dir):
    return blocking.search_hits(views.songs(spark, sf_dir), views.entries(spark, sf_dir), page_size=PAGE_SIZE)


@query
def join_block(spark, sf_dir):
    return _hits(spark, sf_dir)


@query
def join_candidates(spark, sf_dir):
    return joins.join_hits(views.songs(spark, sf_dir), _hits(spark, sf_dir))


@query
def join_anti_worklist(spark, sf_dir):
    return joins.worklist(views.seeds(spark, sf_dir), views.scraped(spark, sf_dir), "Link")


@query
def join_semi_selected(spark, sf_dir):
    selected = views.documents(spark, sf_dir).where("n_chars > 5000").select(F.col("source").alias("artist"))
    chosen = views.catalogue_wide(spark, sf_dir).select("row_idx", "artist", "title")
    return joins.songs_of_selected(chosen, selected)


@query
def join_song_count(spark, sf_dir):
    selected = views.documents(spark, sf_dir).where("n_chars > 5000").select(F.col("source").alias("artist"))
    return joins.song_counts_of_selected(selection.of_section(views.catalogue(spark, sf_dir), "en"), selected)


@query
def join_vocab(spark, sf_dir):
    docs = views.spread_documents(spark, sf_dir, "text")
    return corpus.with_codes(corpus.character_counts(docs), corpus.vocabulary(docs))


# Entity matching


def _pairs(spark, sf_dir):
    return matching.normalised(joins.join_hits(views.songs(spark, sf_dir), _hits(spark, sf_dir)))


@query
def match_norm(spark, sf_dir):
    return _pairs(spark, sf_dir).select("song_id", "pos", "qa", "qt", "ha", "ht", "ht_raw")


def _firsts(spark, sf_dir):
    return matching.catalogue_firsts(views.songs(spark, sf_dir), views.entries(spark, sf_dir))


@query
def match_perfect(spark, sf_dir):
    perfect = _firsts(spark, sf_dir).where(F.col("perfect_pos").isNotNull())
    return perfect.groupBy("song_id").agg(F.min("perfect_pos").alias("pos"), F.min_by("bpm", "perfect_pos").alias("bpm"))


@query
def match_near(spark, sf_dir):
    return matching.near_terms(views.songs(spark, sf_dir), views.entries(spark, sf_dir))


@query
def match_dedup_bpm(spark, sf_dir):
    return _firsts(spark, sf_dir).where(F.col("pos").isNotNull()).select("song_id", "bpm", "pos", "artist_hit")


@query
def match_reduce_artist(spark, sf_dir):
    return matching.reduce_by_artist(_firsts(spark, sf_dir))


@query
def match_decide(spark, sf_dir):
    return matching.decide(_firsts(spark, sf_dir))


@query
def match_nohit(spark, sf_dir):
    """Customers looked up as artists: those whose name and title no entry holds."""
    title = F.when(F.col("c_nationkey") < 12, F.col("c_mktsegment")).otherwise("blue steel")
    songs = views.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("song_id"), F.col("c_name").alias("artist"), title.alias("title")
    )
    return matching.without_hits(songs, views.entries(spark, sf_dir))


@query
def match_bpm(spark, sf_dir):
    return matching.match_catalogue(views.songs(spark, sf_dir), views.entries(spark, sf_dir))


# Aggregation


def _english(spark, sf_dir):
    return selection.long_of_section(views.catalogue_wide(spark, sf_dir), "en", ["row_idx", "artist", "title"])


@query
def agg_range(spark, sf_dir):
    return agg.bpm_range(_english(spark, sf_dir))


@query
def agg_counts(spark, sf_dir):
    return agg.songs_per_artist(_english(spark, sf_dir))


@query
def agg_selection_counts(spark, sf_dir):
    return agg.selection_counts(views.lyrics(spark, sf_dir), F.col("Lyrics") == UNFINISHED, "Artist")


@query
def agg_distinct_artists(spark, sf_dir):
    return agg.distinct_artists(_english(spark, sf_dir))


@query
def agg_summary(spark, sf_dir):
    return agg.summary(_english(spark, sf_dir))


@query
def agg_progress(spark, sf_dir):
    done = ~F.col("bpm").eqNullSafe(NOT_SEARCHED)
    return agg.progress(views.catalogue_wide(spark, sf_dir), done, "artist")


@query
def agg_first_open(spark, sf_dir):
    return agg.first_open_position(views.lyrics(spark, sf_dir), "Lyrics")


# Dedup, sort, limit, set operations


@query
def ded_first(spark, sf_dir):
    return ordering.keep_first(views.links(spark, sf_dir), ["Link", "Artist"], ["row_idx"])


@query
def ded_set(spark, sf_dir):
    return ordering.distinct_values(views.links(spark, sf_dir), "Link")


@query
def srt_artist_title(spark, sf_dir):
    return ordering.sort_by(
        views.catalogue_wide(spark, sf_dir).select("row_idx", "artist", "title", "bpm"), ["artist", "title"], "row_idx"
    )


@query
def srt_distinct(spark, sf_dir):
    return ordering.sorted_distinct(views.catalogue_wide(spark, sf_dir), "artist")


@query
def lim_first(spark, sf_dir):
    return ordering.first_rows(views.links(spark, sf_dir), ["Artist", "row_idx"])


@query
def set_diff(spark, sf_dir):
    return ordering.difference(
        views.seeds(spark, sf_dir), views.scraped(spark, sf_dir).select(F.col("Artist").alias("artist"))
    )


@query
def set_union_all(spark, sf_dir):
    return ordering.append_rows(
        views.links(spark, sf_dir), views.lyrics(spark, sf_dir).select("row_idx", F.col("Lyrics"), "Artist")
    )


@query
def ord_rowidx(spark, sf_dir):
    songs = views.catalogue_wide(spark, sf_dir).select("artist", "title", F.col("row_idx").alias("doc_id"))
    return ordering.with_row_index(songs, ["artist", "title", "doc_id"])


# Scalar functions, on whole texts


@query
def str_lower(spark, sf_dir):
    return views.documents(spark, sf_dir).select("doc_id", F.lower("text").alias("text"))


@query
def str_strip(spark, sf_dir):
    padded = F.concat(F.lit("\t   \x1f"), "text", F.lit(" \x85\n　"))
    return views.spread_documents(spark, sf_dir, "doc_id", "text").select("doc_id", strings.strip(padded).alias("text"))


@query
def str_contains(spark, sf_dir):
    return views.catalogue(spark, sf_dir).select(
        "row_idx", strings.contains(F.lower("text"), F.col("section")).alias("found")
    )


@query
def str_replace(spark, sf_dir):
    return views.documents(spark, sf_dir).select("doc_id", strings.without("text", ",’'").alias("text"))


@query
def str_concat(spark, sf_dir):
    return views.songs(spark, sf_dir).select("song_id", strings.join_words("artist", "title").alias("search"))


@query
def str_format(spark, sf_dir):
    slots = strings.fill("Page {name} of {kind}.", name=F.col("title"), kind=F.col("artist"))
    return views.songs(spark, sf_dir).select("song_id", slots.alias("text"))


@query
def str_split_first(spark, sf_dir):
    return views.page_headers(spark, sf_dir).select("page_id", strings.first_token_int("header").alias("expected"))


@query
def str_slice(spark, sf_dir):
    half = (F.length("text") / 2).cast("int")
    return views.documents(spark, sf_dir).select("doc_id", strings.piece(F.col("text"), half, 40).alias("piece"))


@query
def str_chars(spark, sf_dir):
    chars = strings.characters("text")
    return views.spread_documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.explode(chars).alias("ch")).groupBy("doc_id", "ch").agg(
        F.count("*").alias("n")
    )


@query
def str_agg(spark, sf_dir):
    """All texts of an artist as one corpus, kept as pieces with their offsets."""
    songs = views.documents(spark, sf_dir).select(F.col("source").alias("artist"), F.col("doc_id").alias("row_idx"), "text")
    return corpus.corpus_pieces(songs, "artist")


@query
def url_build(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select(
        "p_partkey", strings.url("https://example.org/artists/", F.concat("p_brand", F.lit(" "), "p_name")).alias("url")
    )


@query
def math_log_exp(spark, sf_dir):
    return views.next_chars(spark, sf_dir).select("context", "ch", F.round(F.exp(F.ln("p") / 2), 9).alias("w"))


@query
def math_round(spark, sf_dir):
    sums = views.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("m"))
    return sums.select("event_type", maths.percent(F.col("n"), F.col("m")).alias("percent"))


@query
def math_min2(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select(
        "event_id", maths.smaller(F.col("event_id"), F.col("user_id")).alias("smaller")
    )


# Training text


@query
def txt_prompt(spark, sf_dir):
    return corpus.prompts(views.catalogue(spark, sf_dir))


@query
def txt_sft_format(spark, sf_dir):
    return corpus.training_examples(views.conversation_pairs(spark, sf_dir))


@query
def txt_token_cap(spark, sf_dir):
    examples = corpus.training_examples(corpus.prompts(views.spread_catalogue(spark, sf_dir)))
    return corpus.cap_tokens(examples)


@query
def txt_windows(spark, sf_dir):
    return corpus.windows(views.spread_documents(spark, sf_dir, "doc_id", "text"), ["doc_id"])


@query
def txt_windows_corpus(spark, sf_dir):
    songs = views.documents(spark, sf_dir).select(F.col("source").alias("artist"), F.col("doc_id").alias("row_idx"), "text")
    return corpus.corpus_windows(songs, "artist").groupBy("artist", "next_char").agg(
        F.count("*").alias("n"),
        F.sum("start").alias("starts"),
        *[F.sum(F.ascii(strings.piece(F.col("sequence"), at, 1))).alias(f"points_{at}") for at in (0, 19, 39)],
    )


@query
def txt_vocab(spark, sf_dir):
    return corpus.vocabulary(views.spread_documents(spark, sf_dir, "text")).select("ch")


@query
def txt_vocab_index(spark, sf_dir):
    return corpus.vocabulary(views.spread_documents(spark, sf_dir, "text"))


@query
def txt_encode(spark, sf_dir):
    """Windows as codes, summed up per label at some places of the window."""
    docs = views.spread_documents(spark, sf_dir, "doc_id", "text")
    coded = corpus.encoded_windows(docs, ["doc_id"], corpus.vocabulary(docs))
    return coded.groupBy("label").agg(
        F.count("*").alias("n"),
        F.sum("start").alias("starts"),
        *[F.sum(F.get("codes", F.lit(at))).alias(f"codes_{at}") for at in (0, 1, 13, 26, 39)],
    )


@query
def txt_onehot(spark, sf_dir):
    """Dense tensors of all windows, added up over the windows."""
    docs = views.spread_documents(spark, sf_dir, "doc_id", "text")
    vocab = stored(corpus.vocabulary(docs), "vocabulary")  # at most as many as Unicode has characters
    size = vocab.count()
    coded = corpus.encoded_windows(docs, ["doc_id"], vocab, runs=True)
    tensors = corpus.one_hot_tensors(coded, ["doc_id", "start"], size)
    return corpus.hot_counts(tensors, size)


@query
def txt_nextchar_dist(spark, sf_dir):
    return views.next_chars(spark, sf_dir).withColumn("p", F.round("p", 9))


# Sampling


@query
def smp_temperature(spark, sf_dir):
    rescaled = sampling.rescale(views.next_chars(spark, sf_dir), 0.5, ["context"])
    return rescaled.select("context", "ch", F.round("p", 9).alias("p"))


@query
def smp_draw(spark, sf_dir):
    return sampling.draw(views.next_chars(spark, sf_dir), 1.0, ["context"], draws=2, seed=7)


@query
def smp_sweep(spark, sf_dir):
    return sampling.sweep(views.next_chars(spark, sf_dir), ["context"], seed=7)


# Pages


@query
def web_fields(spark, sf_dir):
    return web.page_fields(views.pages(spark, sf_dir), views.PAGE_NODES).select("page_id", "lyrics", "title", "features")


@query
def web_unscrapable(spark, sf_dir):
    fields = web.page_fields(views.pages(spark, sf_dir), views.PAGE_NODES)
    return fields.groupBy("status").agg(
        F.count("*").alias("n"), F.count("title").alias("titles"), F.count("features").alias("features")
    )


@query
def web_links(spark, sf_dir):
    return web.page_links(views.pages(spark, sf_dir), None)


@query
def web_link_targets(spark, sf_dir):
    """Targets written in five ways, made absolute."""
    return web.page_links(views.relative_pages(spark, sf_dir), None, resolve=True)


@query
def web_result_count(spark, sf_dir):
    return web.link_completeness(views.page_headers(spark, sf_dir), web.page_links(views.pages(spark, sf_dir), None))


@query
def web_hits(spark, sf_dir):
    return web.search_page_hits(views.pages(spark, sf_dir), views.LIST_ITEM, views.LIST_NODES)


# Incremental collection


@query
def inc_worklist(spark, sf_dir):
    return resume.link_worklist(views.seeds(spark, sf_dir), views.scraped(spark, sf_dir))


def _artists(spark, sf_dir):
    return views.documents(spark, sf_dir).select(F.col("source").alias("artist"))


@query
def inc_stage(spark, sf_dir):
    users = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("artist"))
    return resume.next_stage(
        resume.link_worklist(users, views.links(spark, sf_dir)),
        resume.lyric_worklist(_artists(spark, sf_dir), views.lyrics(spark, sf_dir)),
    )


@query
def inc_resume_links(spark, sf_dir):
    stored = views.links(spark, sf_dir)
    new = views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_idx"),
        F.concat(F.lit("https://x/"), F.lower("o_orderstatus")).alias("Link"),
        F.col("o_custkey").cast("string").alias("Artist"),
    )
    return resume.resume_links(stored, new)


@query
def inc_resume_lyrics(spark, sf_dir):
    stored = views.lyrics(spark, sf_dir)
    results = views.documents(spark, sf_dir).where("lang = 'en'").select(
        F.col("doc_id").alias("row_idx"), F.concat(F.lit("new "), "text").alias("Lyrics")
    )
    return resume.resume_lyrics(stored, results)


@query
def inc_first_lyrics(spark, sf_dir):
    """A first lyric session: begun from the links, filled by what was read for its open rows."""
    begun = resume.first_lyrics(views.links(spark, sf_dir))
    read = views.documents(spark, sf_dir).select(F.col("doc_id").alias("row_idx"), F.col("text").alias("Lyrics"))
    return resume.resume_lyrics(begun, read.join(resume.open_lyrics(begun), "row_idx", "left_semi"))


@query
def inc_fail_mark(spark, sf_dir):
    failed = views.table(spark, sf_dir, "labels").where("toxic = 1").select(
        F.col("doc_id").alias("row_idx"), F.col("doc_id").cast("string").alias("Artist")
    )
    return resume.mark_failed(views.links(spark, sf_dir), failed, "Link")


@query
def inc_skip_done(spark, sf_dir):
    return resume.open_bpms(views.bpms(spark, sf_dir)).select("row_idx", "Rappers", "Songs")


def _event_links(spark, sf_dir):
    stored = views.table(spark, sf_dir, "events")
    if stored.inputFiles()[0].endswith("/events.parquet"):
        # The table is one file; a stream reads folders.
        stream = incremental.link_stream(spark, sf_dir, stored.schema, only="events.parquet")
    else:
        stream = incremental.link_stream(spark, f"{sf_dir}/events.parquet", stored.schema)
    link = F.when(F.col("event_type") == "error", UNFINISHED).otherwise(F.concat(F.lit("https://x/"), F.col("event_type")))
    return stream.select(
        F.col("event_id").alias("row_idx"), link.alias("Link"), F.col("user_id").cast("string").alias("Artist")
    )


@query
def inc_checkpoint(spark, sf_dir):
    base = new_dir(spark, "links")
    incremental.collect_links(_event_links(spark, sf_dir), f"{base}/table", f"{base}/checkpoint")
    return incremental.collected_links(spark, f"{base}/table")


@query
def inc_dedup_stream(spark, sf_dir):
    base = new_dir(spark, "links")
    incremental.collect_distinct(_event_links(spark, sf_dir), f"{base}/table", f"{base}/checkpoint", ["Link", "Artist"])
    return spark.read.parquet(f"{base}/table").select("Link", "Artist")


# Whole path


@query
def merge_catalogue(spark, sf_dir):
    """Songs with their tempos, sorted, written and read back in order."""
    path = new_dir(spark, "catalogue")
    merged = merging.merged_catalogue(views.catalogue_wide(spark, sf_dir), views.bpms(spark, sf_dir))
    merging.write_catalogue(merged, path)
    return merging.read_catalogue(spark, path).withColumn("row_idx", F.col("row_idx").cast("bigint"))


@query
def training_text(spark, sf_dir):
    """Flagship: section, artists and tempo range chosen, turned into training text."""
    chosen = selection.of_artists(_english(spark, sf_dir), ["src1", "src7"])
    return corpus.training_examples(corpus.prompts(selection.in_bpm_range(chosen, 0, 150)))
