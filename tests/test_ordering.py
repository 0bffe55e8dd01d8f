import random

import pytest
from pyspark.sql import functions as F

from conftest import large_tables
from songloom.operators import joins, ordering, selection
from songloom.operators.equijoin import splittable_join


def test_row_index_is_dense_for_any_partitioning(spark):
    values = list(range(1000))
    random.Random(3).shuffle(values)
    df = spark.createDataFrame([(v % 7, v) for v in values], "k long, v long")
    expected = [(k, v, i) for i, (k, v) in enumerate(sorted((v % 7, v) for v in values))]
    for parts in (1, 5, 13):
        got = ordering.with_row_index(df.repartition(parts), ["k", "v"]).collect()
        assert sorted((r.k, r.v, r.row_idx) for r in got) == expected


def test_row_index_with_one_key_holding_most_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), "id")
    numbered = ordering.with_row_index(df, ["k", "id"])
    assert [r[0] for r in numbered.orderBy("k", "id").select("row_idx").collect()] == list(range(3000))


def test_row_index_of_an_empty_table(spark):
    assert ordering.with_row_index(spark.range(0), ["id"]).collect() == []


def test_row_index_in_mixed_directions_with_nulls_and_ties(spark):
    rows = [(i % 5 if i % 7 else None, float(i % 11) if i % 3 else None, i) for i in range(2000)]
    rows += [(1, float("nan"), 2000), (1, 2.0, 2001)]
    df = spark.createDataFrame(rows, "a int, b double, _offset long").repartition(9)
    keys, falling = ["a", "b", "_offset"], ["b"]
    numbered = ordering.with_row_index(df, keys, descending=falling)
    assert numbered.columns == [*df.columns, "row_idx"]
    expected = [tuple(r) for r in df.orderBy("a", F.desc("b"), "_offset").coalesce(1).collect()]
    got = [tuple(r)[:3] for r in sorted(numbered.collect(), key=lambda r: r.row_idx)]
    assert list(map(str, got)) == list(map(str, expected))
    tied = ordering.with_row_index(df.select("a"), ["a"])
    assert sorted(r.row_idx for r in tied.collect()) == list(range(2002))


def test_row_index_shuffles_only_keys_for_its_ranges(spark):
    """The index of ranges reads and moves the keys; nothing is stored; other columns are shuffled once."""
    df = spark.range(500).select("id", F.repeat(F.lit("x"), 50).alias("text")).repartition(3)
    ranges = ordering.range_index(df, ["id"])
    assert "text" not in ranges._jdf.queryExecution().optimizedPlan().toString()
    found = ranges.orderBy("range").collect()
    assert len(found) > 1 and [r.first.id for r in found] == [r.offset for r in found]
    plan = ordering.with_row_index(df, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "RDD" not in plan and "Join" not in plan


@pytest.mark.parametrize("right, expected", [("12", [("a", "1"), ("b", "2"), ("c", None)]), ("1234", [("a", "1"), ("b", "2"), ("c", "3")])])
def test_positional_join(spark, right, expected):
    left = spark.createDataFrame(list(enumerate("abc")), "row_idx long, l string")
    other = spark.createDataFrame(list(enumerate(right)), "row_idx long, r string")
    got = joins.join_by_position(left, other).orderBy("row_idx").collect()
    assert [(r.l, r.r) for r in got] == expected


def test_join_by_name_ignores_commas_and_takes_the_first(spark):
    songs = spark.createDataFrame([(0, "a", "x, y"), (1, "a", "z"), (2, None, "z")], "row_idx long, artist string, title string")
    bpms = spark.createDataFrame(
        [(5, "a", "x y", "2"), (4, "a", "x y", "1"), (6, "b", "z", "9")], "row_idx long, Rappers string, Songs string, BPM string"
    )
    got = joins.join_by_name(songs, bpms).orderBy("row_idx").collect()
    assert [r.bpm for r in got] == ["1", None, None]


def test_sort_puts_nulls_last(spark):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(["b", "a", "é", "Z", None, "a"])], "row_idx long, artist string")
    assert [r.artist for r in ordering.sort_by(df, ["artist"], "row_idx").collect()] == ["Z", "a", "a", "b", "é", None]


def test_keep_first(spark):
    rows = [(0, "u", "x"), (1, None, "x"), (2, None, "x"), (3, "u", "x"), (4, "u", "y")]
    df = spark.createDataFrame(rows, "row_idx long, Link string, Artist string").repartition(3)
    kept = ordering.keep_first(df, ["Link", "Artist"], ["row_idx"])
    assert sorted(r.row_idx for r in kept.collect()) == [0, 1, 4]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "1, Partial" in plan and "1, Final" in plan


def test_append_moves_positions(spark):
    old = spark.createDataFrame([(0, "a"), (7, "b")], "row_idx long, v string")
    new = spark.createDataFrame([(0, "c"), (1, "d")], "row_idx long, v string")
    got = ordering.append_rows(old, new).orderBy("row_idx").collect()
    assert [tuple(r) for r in got] == [(0, "a"), (7, "b"), (8, "c"), (9, "d")]
    first = ordering.append_rows(old.where("false"), new).orderBy("row_idx").collect()
    assert [r.row_idx for r in first] == [0, 1]


def test_worklist(spark):
    seeds = spark.createDataFrame([(s,) for s in "abcdd"], "artist string")
    table = spark.createDataFrame(
        [("a", "ok"), ("b", "ok"), ("b", "Unfinished"), ("c", "Unfinished"), ("e", None)], "Artist string, Link string"
    )
    assert sorted(r[0] for r in joins.worklist(seeds, table, "Link").collect()) == ["b", "c", "d"]


def test_worklist_null_counts_as_done_unless_asked(spark):
    seeds = spark.createDataFrame([("a",), ("b",)], "artist string")
    table = spark.createDataFrame([("a", None), ("b", "t")], "Artist string, Lyrics string")
    assert joins.worklist(seeds, table, "Lyrics").isEmpty()
    assert [r[0] for r in joins.worklist(seeds, table, "Lyrics", null_is_open=True).collect()] == ["a"]


def test_song_counts(spark):
    songs = spark.createDataFrame([("a",), ("a",), ("b",)], "artist string")
    selected = spark.createDataFrame([("a",), ("a",), ("z",)], "artist string")
    got = {r.artist: r.songs for r in joins.song_counts_of_selected(songs, selected).collect()}
    assert got == {"a": 2, "z": 0}


def test_joins_can_be_split_at_a_hot_key(spark):
    """A third of the songs has one artist and title."""
    songs = spark.range(60_000).selectExpr(
        "id as row_idx", "if(id % 3 = 0, 'hot', concat('a', id % 500)) as artist",
        "if(id % 3 = 0, 'hot', concat('t', id % 500)) as title",
    ).repartition(8)
    names = songs.select("artist", "title").distinct()
    bpms = names.selectExpr("artist as Rappers", "title as Songs", "'90' as BPM", "0L as row_idx")
    with large_tables(spark):
        for joined in (joins.join_by_name(songs, bpms), joins.songs_of_selected(songs, names), selection.of_artists(songs, names)):
            assert len(joined.collect()) == 60_000
            assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


def test_null_keys_meet_nothing(spark):
    left = spark.createDataFrame([(None,), ("a",)], "k string")
    right = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    rows = splittable_join(left, right, ["k"], "left").collect()
    assert {(r.k, r.v) for r in rows} == {(None, None), ("a", 2)}
