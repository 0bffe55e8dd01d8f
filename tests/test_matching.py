import random

import pytest

from conftest import large_tables
from pyspark.sql import functions as F

from songloom.operators.blocking import search_hits
from songloom.operators.holding import first_holders, holders
from songloom.operators.matching import catalogue_firsts, match_bpm, match_catalogue, without_hits

# case: query artist, query title, hits (artist, title, bpm), expected bpm and status
CASES = {
    "M1": ("Drake", "God’s Plan", [("drake remix", "zzz", "99"), ("drake", "god's plan", "77")], 77, "PERFECT"),
    "M2": ("Drake", "Foo", [("drake", "other", "90"), ("x", "y", "10")], 90, "NEAR1"),
    "M3": ("Drake", "Foo", [("drake ft x", "a", "150"), ("drake", "b", "75")], 75, "NEAR2_MIN"),
    "M4": ("Drake", "Foo", [("drake", "a", "9"), ("drake", "b", "10")], 9, "NEAR2_MIN"),
    "M5": ("Drake", "Foo", [("drake", "a", "1"), ("drake", "b", "2"), ("drake", "c", "3")], None, "BOOKMARKED"),
    "M6": (
        "Drake", "Plan",
        [("cover band", "plan remix", "80"), ("drake & co", "zzz", "80"), ("tribute", "plan live", "81"), ("other", "plan dub", "82")],
        None, "BOOKMARKED",
    ),
    "M7": ("Drake", "Plan", [("cover", "plan remix", "70"), ("drake", "zz", "71"), ("trib", "plan", "72")], 71, "NEAR1"),
    "M8": ("Drake", "Foo", [("drake", "a", "80"), ("drake", "b", "80")], 80, "NEAR1"),
    "M9": ("Drake", "Foo", [], None, "BOOKMARKED"),
    "M10": ("Drake", "Foo", [("x", "y", "5")], None, "BOOKMARKED"),
    "M11": ("Drake", "Foo", [("drake", "a", "n/a"), ("drake", "b", "75")], None, "INVALID_BPM"),
    "M12": ("Drake", "God's Plan", [("drake", "god's plan", "77")], 77, "NEAR1"),
    "M13": ("Lil' Kim", "Foo", [("x", "foo lil' kim", "1"), ("y", "foo a", "2"), ("z", "foo b", "3")], 1, "NEAR1"),
    "M14": ("Dangelo", "Foo", [("x", "foo d'angelo", "1"), ("y", "foo a", "2"), ("z", "foo b", "3")], None, "BOOKMARKED"),
    "perfect without number": ("Drake", "Foo", [("drake", "foo", "fast")], None, "INVALID_BPM"),
    "one near without number": ("Drake", "Foo", [("drake", "a", "fast")], None, "INVALID_BPM"),
    "hit side is stripped": ("Drake", "Foo", [(" drake ", "foo\t", "70")], 70, "PERFECT"),
    "first of two perfect": ("Drake", "Foo", [("drake", "foo", "70"), ("drake", "foo", "60")], 70, "PERFECT"),
    "null hit": ("Drake", "Foo", [(None, None, "70")], None, "BOOKMARKED"),
}


@pytest.mark.parametrize("parts", [1, 7])
def test_golden_matches(spark, parts):
    names = list(CASES)
    songs = spark.createDataFrame([(i, CASES[n][0], CASES[n][1]) for i, n in enumerate(names)], "song_id long, artist string, title string")
    hits = spark.createDataFrame(
        [(i, pos, *hit) for i, n in enumerate(names) for pos, hit in enumerate(CASES[n][2])],
        "song_id long, pos int, artist_name string, song_name string, bpm string",
    ).repartition(parts)
    got = {names[r.song_id]: (r.bpm, r.match_status) for r in match_bpm(songs, hits).collect()}
    assert got == {n: (CASES[n][3], CASES[n][4]) for n in names}


def test_symmetric_apostrophes(spark):
    songs = spark.createDataFrame([(0, "Drake", "God's Plan")], "song_id long, artist string, title string")
    hits = spark.createDataFrame([(0, 0, "drake", "god’s plan", "77")], "song_id long, pos int, artist_name string, song_name string, bpm string")
    assert match_bpm(songs, hits, symmetric=True).first().match_status == "PERFECT"


def test_matching_plan_has_no_window_over_hits(spark):
    songs = spark.createDataFrame([(0, "a", "t")], "song_id long, artist string, title string")
    hits = spark.createDataFrame([(0, 0, "a", "t", "1")], "song_id long, pos int, artist_name string, song_name string, bpm string")
    plan = match_bpm(songs, hits)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def brute_force(songs, entries, k):
    hits = []
    for song_id, artist, title in songs:
        words = set(f"{artist} {title}".lower().split())
        scored = []
        for entry_id, name, song, _ in entries:
            shared = len(words & set(f"{name} {song}".lower().split()))
            if shared:
                scored.append((-shared, entry_id))
        hits += [(song_id, pos, entry_id, -score) for pos, (score, entry_id) in enumerate(sorted(scored)[:k])]
    return sorted(hits)


@pytest.mark.parametrize("hot_df, max_hot, k", [(1000, 8, 4), (3, 8, 4), (3, 2, 4), (0, 8, 3), (0, 1, 3), (8, 3, 50)])
def test_search_hits_equal_brute_force(spark, hot_df, max_hot, k):
    rng = random.Random(hot_df * 100 + max_hot)
    words = ["the", "The", "of", "love", "night", "x1", "x2", "x3", "rare", "moon", "sun", "fire"]

    def text(n):
        # A third of all texts is the same, and "the" is in most of them.
        if rng.random() < 0.33:
            return "the love"
        return " ".join(rng.choice(words[: rng.randint(3, len(words))]) for _ in range(rng.randint(1, n)))

    songs = [(i, text(3), text(3)) for i in range(60)] + [(60, "zzz", "qqq"), (61, "", "")]
    entries = [(1000 - i, text(3), text(4), str(i)) for i in range(120)]
    got = search_hits(
        spark.createDataFrame(songs, "song_id long, artist string, title string"),
        spark.createDataFrame(entries, "id long, artist_name string, song_name string, bpm string").repartition(3),
        page_size=k, hot_df=hot_df, max_hot=max_hot,
    )
    assert sorted((r.song_id, r.pos, r.id, r.shared) for r in got.collect()) == brute_force(songs, entries, k)


def test_song_with_most_hits_can_be_split(spark):
    """The aggregation after the join has a shuffle of its own, so adaptive execution may split the join."""
    songs = spark.createDataFrame([(i, f"a{i}", "t") for i in range(50)], "song_id long, artist string, title string")
    hits = spark.range(40_000).selectExpr(
        "if(id % 3 = 0, 7, id % 50) as song_id", "cast(id as int) as pos", "concat('a', id % 50) as artist_name",
        "'t' as song_name", "cast(60 + id % 100 as string) as bpm",
    )
    with large_tables(spark):
        matched = match_bpm(songs, hits)
        assert len(matched.collect()) == 50
        assert "skew=true" in matched._jdf.queryExecution().executedPlan().toString()


def test_holders_equal_brute_force(spark):
    rng = random.Random(3)

    def text(n):
        return " ".join("".join(rng.choice("aab") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, n)))

    terms = sorted({text(4) for _ in range(80)} | {"", " ", "  ", "   ", "a", "b b"})
    texts = sorted({text(6) for _ in range(120)} | {"", " ", "a", "ab  ba"})
    got = holders(
        spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(t,) for t in texts], "text string")
    )
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a in terms for b in texts if a in b)


def test_catalogue_equals_matching_on_all_pairs(spark):
    rng = random.Random(5)
    words = ["Love", "night", "the", "moon's", "sun", "fire"]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))

    songs = [(i, text(2), text(2)) for i in range(40)] + [(40, "zzz", "qqq"), (41, None, "sun")]
    entries = [(i, text(2), text(4), rng.choice(["90", "100", "110", "x"])) for i in range(60)] + [(60, None, None, None)]
    song_rows = spark.createDataFrame(songs, "song_id long, artist string, title string")
    entry_rows = spark.createDataFrame(entries, "id long, artist_name string, song_name string, bpm string")
    pairs = [(s[0], e[0], *e[1:]) for s in songs for e in entries]
    hits = spark.createDataFrame(pairs, "song_id long, pos long, artist_name string, song_name string, bpm string")
    wanted = sorted(map(tuple, match_bpm(song_rows, hits).select("song_id", "bpm", "match_status").collect()))
    got = match_catalogue(song_rows, entry_rows).select("song_id", "bpm", "match_status").collect()
    assert sorted(map(tuple, got)) == wanted
    assert 40 in {r.song_id for r in without_hits(song_rows, entry_rows).collect()}


def test_terms_that_share_a_common_sequence(spark):
    """Thousands of terms and words that all hold the same letters meet only where they do."""
    import time

    count = 32_000
    terms = spark.range(count).selectExpr("concat('the', lpad(conv(id * 7919, 10, 36), 6, 'x')) as term")
    texts = spark.range(count).selectExpr("concat(lpad(conv(id * 104729, 10, 36), 5, 'y'), 'the', lpad(conv(id * 7919 * 3, 10, 36), 6, 'x')) as text")
    begin = time.perf_counter()
    got = holders(terms, texts).collect()
    assert time.perf_counter() - begin < 60
    asked = {r.term for r in terms.collect()}
    wanted = [(t, x) for x, in texts.collect() for t in {x[i : i + 9] for i in range(len(x) - 8)} if t in asked]
    assert wanted and sorted(map(tuple, got)) == sorted(wanted)


def test_first_holders_never_meet_texts(spark):
    """A term in most texts costs as much as the different words that hold it."""
    rows = spark.range(200_000).selectExpr("concat('the ', id % 50) as text", "string(id % 7) as bpm", "id as pos")
    terms = spark.createDataFrame([("the",), ("e 1",), ("the 12",), ("",), ("zz",)], "term string")
    got = sorted(map(tuple, first_holders(terms, rows, ["bpm"], "pos").collect()))
    wanted = {}
    for i in range(3000):
        for term in ("the", "e 1", "the 12", "", "zz"):
            if term in f"the {i % 50}":
                wanted.setdefault((term, str(i % 7)), i)
    assert got == sorted((*k, v) for k, v in wanted.items())


def test_firsts_of_songs_are_found_in_many_tasks(spark):
    """A song has a row per tempo; a catalogue in one small file is no reason to make all of them in one task."""
    songs = spark.range(0, 400, 1, 1).selectExpr("id as song_id", "concat('a', id % 4) as artist", "if(id % 5 = 0, null, concat('t', id)) as title")
    entries = spark.range(0, 60, 1, 1).selectExpr("id", "concat('a', id % 4) as artist_name", "'x' as song_name", "string(60 + id) as bpm")
    firsts = catalogue_firsts(songs, entries).where("pos is not null")
    tasks = [r["count"] for r in firsts.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(tasks) == 400 * 15 and len(tasks) > 3 and max(tasks) < sum(tasks) / 2
