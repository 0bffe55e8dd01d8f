"""A page of search hits for songs: the ``k`` catalogue entries sharing most words with artist and title.

A page is what a search site shows; matching (``matching.match_catalogue``) looks at all entries instead.

Hits are ranked by the number of different shared words, then by entry id; entries that share no word
are no hits. The result is exact whatever the word frequencies:

* Entries with the same words are one *bag*, of which only the ``k`` smallest ids can be hits. Songs
  with the same words are one bag too. So copies never meet each other.
* Words in at most ``hot_df`` bags are *rare*. Bags that share a rare word meet in an equi-join on that
  word, which at most ``hot_df`` entry bags can answer.
* *Hot* words are never joined pairwise. Every bag stands for all sets of its hot words; each set keeps
  the ``k`` smallest ids of the entries that contain it. If a song and an entry share exactly the hot
  words S, the entry is either among those kept for S, or ``k`` entries that rank no lower are. Merging
  both ways, with the higher count per entry, leaves the true first ``k``.
* A bag with more than ``max_hot`` hot words has too many sets and meets others word by word; ordinary
  artist and title texts have few words, so such bags are rare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songloom.functions.strings import WHITESPACE, join_words
from songloom.operators.equijoin import splittable_join
from songloom.session import stored


def bag_of_words(*texts: str) -> Column:
    """Different lower-case words, sorted and joined by blanks."""
    words = F.split(F.lower(join_words(*texts)), rf"{WHITESPACE}+")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(words, lambda w: w != ""))), " ")


def _words(bag: str) -> Column:
    return F.filter(F.split(bag, " "), lambda w: w != "")


def _smallest_ids(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` smallest ids per key; the limit is applied before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("id"))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def _best(df: DataFrame, key: str, score: str, id_column: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), id_column))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k)


def _split_words(bags: DataFrame, hot: DataFrame, max_hot: int) -> DataFrame:
    """Per bag its rare words, its hot words and whether it has too many hot ones for sets."""
    words = bags.select("*", F.explode(_words("bag")).alias("word")).join(hot, "word", "left")
    is_hot = F.coalesce("hot", F.lit(False))
    return (
        words.groupBy(*bags.columns)
        .agg(
            F.array_sort(F.collect_list(F.when(is_hot, F.col("word")))).alias("hot_words"),
            F.array_sort(F.collect_list(F.when(~is_hot, F.col("word")))).alias("rare_words"),
        )
        .withColumn("long", F.size("hot_words") > max_hot)
    )


def _index_rows(bags: DataFrame, emits_all_when: Column) -> DataFrame:
    """Words a bag is met by: rare ones, and hot ones where long bags take part.

    ``meet`` keeps apart rare words, hot words of long songs and hot words of long entries.
    """
    tagged = lambda words, tag: F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(tag).alias("meet")))
    none = F.filter(tagged("hot_words", ""), lambda _: F.lit(False))
    rows = F.concat(
        tagged("rare_words", "rare"),
        F.when(emits_all_when[0], tagged("hot_words", "long song")).otherwise(none),
        F.when(emits_all_when[1], tagged("hot_words", "long entry")).otherwise(none),
    )
    return bags.select("*", F.inline(rows))


def _sets(bag: str) -> Column:
    """All non-empty sets of the hot words, as sorted texts with their sizes."""
    return F.expr(
        f"transform(sequence(1, cast(power(2, size({bag})) as int) - 1), m -> "
        f"struct(array_join(filter({bag}, (w, i) -> (shiftright(m, i) & 1) = 1), ' ') as words, bit_count(m) as n))"
    )


def search_hits(
    songs: DataFrame, entries: DataFrame, page_size: int, hot_df: int = 100, max_hot: int = 10
) -> DataFrame:
    """Hits ``song_id, pos, id, shared`` and the entry's columns, for every song that has any.

    ``songs``: ``song_id, artist, title``. ``entries``: ``id, artist_name, song_name, bpm``. Bags are computed
    at once and stored in the shared folder; the rest is lazy.
    """
    k = page_size
    wanted = songs.select("song_id", bag_of_words("artist", "title").alias("bag")).where(F.col("bag") != "")
    offered = entries.select("id", bag_of_words("artist_name", "song_name").alias("bag")).where(F.col("bag") != "")
    first_ids = (
        _smallest_ids(offered, "bag", k).groupBy("bag")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )
    frequency = first_ids.select(F.explode(_words("bag")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    hot = frequency.where(F.col("n") > hot_df).select("word", F.lit(True).alias("hot"))
    # Both are used twice below and small against the tables they come from: computed once.
    song_bags = stored(_split_words(wanted.select("bag").distinct(), hot, max_hot), "song-bags")
    entry_bags = stored(_split_words(first_ids, hot, max_hot), "entry-bags")

    # Bags that meet by a word. A pair that shares several words is kept at one of them only.
    asked = _index_rows(song_bags, (F.col("long"), ~F.col("long"))).select(
        F.col("bag").alias("song_bag"), "word", "meet",
        F.col("rare_words").alias("song_rare"), F.col("hot_words").alias("song_hot"),
    )
    found = _index_rows(entry_bags, (F.lit(True), F.col("long"))).select("word", "meet", "rare_words", "hot_words", "ids")
    shared_rare = F.array_intersect("song_rare", "rare_words")
    shared_hot = F.array_intersect("song_hot", "hot_words")
    met = (
        asked.join(found, ["word", "meet"])
        .where(F.col("word") == F.coalesce(F.array_min(shared_rare), F.array_min(shared_hot)))
        .select("song_bag", "ids", (F.size(shared_rare) + F.size(shared_hot)).alias("shared"))
        .withColumn("first_id", F.col("ids")[0])
    )
    by_word = _best(met, "song_bag", "shared", "first_id", k).select("song_bag", F.explode("ids").alias("id"), "shared")

    # Entries that contain a set of hot words.
    short_hot = (~F.col("long")) & (F.size("hot_words") > 0)
    hot_bag = F.array_join("hot_words", " ").alias("hot_bag")
    hot_ids = _smallest_ids(entry_bags.where(short_hot).select(hot_bag, F.explode("ids").alias("id")), "hot_bag", k)
    with_sets = (
        hot_ids.groupBy("hot_bag").agg(F.collect_list("id").alias("ids"))
        .select("ids", _words("hot_bag").alias("_hot"))
        .select("ids", F.inline(_sets("_hot")))
    )
    in_set = _smallest_ids(with_sets.select("words", F.explode("ids").alias("id")), "words", k)
    hot_song_bags = song_bags.where(short_hot).select(F.col("bag").alias("song_bag"), "hot_words", hot_bag)
    asked_sets = hot_song_bags.select("hot_bag", "hot_words").distinct().select("hot_bag", F.inline(_sets("hot_words")))
    by_set = _best(
        splittable_join(asked_sets, in_set.select("words", "id"), ["words"]).groupBy("hot_bag", "id").agg(F.max("n").alias("shared")),
        "hot_bag", "shared", "id", k,
    )
    by_set = splittable_join(
        hot_song_bags.select("song_bag", "hot_bag"), by_set.select("hot_bag", "id", "shared"), ["hot_bag"]
    ).select("song_bag", "id", "shared")

    merged = by_word.unionByName(by_set).groupBy("song_bag", "id").agg(F.max("shared").alias("shared"))
    ranked = _best(merged, "song_bag", "shared", "id", k).select(
        F.col("song_bag").alias("bag"), (F.col("_rank") - 1).alias("pos"), "id", "shared"
    )
    # Entry columns are fetched per bag of songs, before the rows are multiplied by the songs of a bag.
    return splittable_join(wanted, ranked.join(entries, "id"), ["bag"]).drop("bag")
