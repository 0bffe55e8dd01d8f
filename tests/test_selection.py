import pytest
from pyspark.sql import functions as F

from songloom.functions import coercion, strings
from songloom.operators import aggregates, selection


def column(df):
    return [r[0] for r in df.collect()]


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame(
        [
            (0, "A", "one", "120", "la la", None),
            (1, "A", "two", "BOOKMARKED", "na na", "x"),
            (2, "B", "three", "90.7", None, "y"),
            (3, "B", "four", None, "do do", None),
            (4, "C", "five", "0", "mi mi", None),
        ],
        "row_idx long, artist string, title string, bpm string, hook string, verse string",
    )


def test_bpm_coercion(spark):
    texts = ["120", "120.7", "-3.9", " 95 ", "1e2", "BOOKMARKED", "YEEHAW", "", None, "nan", "1d", "inf", "1_000", "1e400"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = column(df.orderBy("i").select(coercion.bpm_number("t")))
    assert got == [120, 120, -3, 95, 100, 0, 0, 0, 0, 0, 0, 0, 0, 0]


def test_strict_int(spark):
    df = spark.createDataFrame([(0, " 95 "), (1, "+5"), (2, "12.5"), (3, "n/a"), (4, None)], "i long, t string")
    assert column(df.orderBy("i").select(coercion.strict_int("t"))) == [95, 5, None, None, None]


def test_strip_is_unicode_aware_and_keeps_inner_runs(spark):
    cases = ["  a b  ", "\x1f a", "b\x85 ", "　é ", "", " \t ", "x \n y", "no"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i long, t string")
    assert column(df.orderBy("i").select(strings.strip("t"))) == [c.strip() for c in cases]


def test_strip_is_linear_in_inner_runs(spark):
    df = spark.createDataFrame([("a" + " " * 200_000 + "b",)], "t string")
    assert column(df.select(F.length(strings.strip("t")))) == [200_002]


def test_small_string_functions(spark):
    row = spark.createDataFrame([("A b/ü", "12 Songs", "a\U0001f600b", "")], "a string, h string, c string, e string").select(
        strings.url("https://example.org/", F.col("a")).alias("url"),
        strings.first_token_int("h").alias("n"),
        strings.first_token_int("a").alias("none"),
        strings.characters("c").alias("chars"),
        strings.characters("e").alias("empty"),
        strings.piece(F.col("c"), 1, 2).alias("piece"),
        strings.without("a", "A ").alias("less"),
        strings.join_words("a", "h").alias("words"),
    ).first()
    assert row.url == "https://example.org/A%20b%2F%C3%BC"
    assert (row.n, row.none, row.chars, row.empty) == (12, None, ["a", "\U0001f600", "b"], [])
    assert (row.piece, row.less, row.words) == ("\U0001f600b", "b/ü", "A b/ü 12 Songs")


def test_sections_and_unpivot(wide):
    assert selection.section_columns(wide.drop("row_idx")) == ["hook", "verse"]
    long = selection.unpivot_sections(wide, ["row_idx", "artist", "title", "bpm"])
    assert sorted((r.row_idx, r.section) for r in long.collect()) == [
        (0, "hook"), (1, "hook"), (1, "verse"), (2, "verse"), (3, "hook"), (4, "hook"),
    ]


@pytest.fixture(scope="module")
def long(wide):
    return selection.unpivot_sections(wide, ["row_idx", "artist", "title", "bpm"])


def test_select_by_artist_and_range(long):
    by_artist = selection.select_slice(long, "hook", artists=["A", "A"])
    assert sorted(column(by_artist.select("row_idx"))) == [0, 1]
    both = selection.select_slice(long, "hook", artists=["A"], bpm_range=(0, 0))
    assert column(both.select("row_idx")) == [1]
    empty = selection.select_slice(long, "hook", bpm_range=(120, 0))
    assert empty.isEmpty()


def test_wide_catalogue_gives_the_same_slice_and_reads_one_section(spark, wide, tmp_path):
    from_long = selection.select_slice(selection.unpivot_sections(wide, ["artist", "title", "bpm", "row_idx"]), "hook", ["A", "B"])
    wide.drop("row_idx").write.parquet(str(tmp_path / "wide"))
    stored = spark.read.parquet(str(tmp_path / "wide"))
    from_wide = selection.select_slice(stored, "hook", ["A", "B"])
    columns = ["artist", "title", "bpm", "section", "text"]
    assert sorted(map(tuple, from_wide.collect())) == sorted(map(tuple, from_long.select(columns).collect()))
    plan = from_wide._jdf.queryExecution().executedPlan().toString()
    assert "verse" not in plan.split("ReadSchema")[1] and "IsNotNull(hook)" in plan
    with pytest.raises(ValueError, match="no such section"):
        selection.select_slice(stored, "bpm")
    assert selection.select_slice(stored, "hook", known_only=True).count() == 2


def test_known_only_keeps_nulls_as_zero(long):
    kept = selection.select_slice(long, "hook", known_only=True)
    assert sorted((r.row_idx, r.bpm) for r in kept.collect()) == [(0, 120), (3, 0)]


def test_domain_checks(long):
    with pytest.raises(ValueError, match="no such section"):
        selection.select_slice(long, "bridge")
    with pytest.raises(ValueError, match="no such artists"):
        selection.select_slice(long, "hook", artists=["A", "Z"])
    with pytest.raises(ValueError, match="outside"):
        selection.select_slice(long, "hook", bpm_range=(0, 121))
    with pytest.raises(ValueError, match="outside"):
        selection.of_artists_in_range(selection.of_section(long, "verse"), ["B"], 0, 90)


def test_artists_given_as_table(spark, long):
    table = spark.createDataFrame([("B",), ("B",), ("Z",)], "artist string")
    assert sorted(column(selection.of_artists(long, table).select("row_idx"))) == [2, 3]


def test_unfinished_rows_are_dropped_and_counted(spark):
    df = spark.createDataFrame([("Unfinished",), (None,), ("u",), ("Unfinished",)], "Link string")
    kept, seen = selection.without_unfinished(df, "Link")
    assert sorted(column(kept), key=str) == [None, "u"]
    assert seen.get["dropped"] == 2


def test_summary(long):
    rows = {r.artist: r for r in aggregates.summary(selection.of_section(long, "hook")).collect()}
    assert (rows[None].min_bpm, rows[None].max_bpm, rows[None].songs, rows[None].artists) == (0, 120, 5 - 1, 3)
    assert (rows["A"].songs, rows["C"].max_bpm) == (2, 0)


def test_progress(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", None)], "artist string, v int")
    rows = {r.artist: r for r in aggregates.progress(df, F.col("v").isNotNull(), "artist").collect()}
    assert rows[None].percent == 33.333 and rows[None].overall
    assert rows["a"].percent == 50.0 and not rows["a"].overall
    assert aggregates.progress(df, F.col("v").isNotNull()).first().total == 3


def test_first_open_position(spark):
    df = spark.createDataFrame([(0, "t1"), (1, "Unscrapable"), (2, None), (3, None)], "row_idx long, Lyrics string")
    assert aggregates.first_open_position(df, "Lyrics").first()[0] == 2
    assert aggregates.first_open_position(df.where("row_idx < 2"), "Lyrics").first()[0] is None


def wide_catalogue(spark):
    rows = [("a", "t1", "90", "x", None), ("a", "t2", "YEEHAW", "y", "z"), ("b", "t3", "120.7", "w", None), (None, "t4", "80", "v", None)]
    return spark.createDataFrame(rows, "artist string, title string, bpm string, hook string, verse string")


def test_checked_slice(spark):
    wide = wide_catalogue(spark)
    cut = lambda *a: [tuple(r) for r in selection.checked_slice(wide, *a).orderBy("title").collect()]
    assert cut("hook", ["a", "a"], (0, 90)) == [("a", "t1", 90, "hook", "x"), ("a", "t2", 0, "hook", "y")]
    assert [r[1] for r in cut("hook", (), (80, 120))] == ["t1", "t3", "t4"] and len(cut("hook")) == 4
    assert cut("verse", ["a"]) == [("a", "t2", 0, "verse", "z")]
    for asked, said in ((("hook", ["a", "zz"]), "zz"), (("hook", ["a"], (0, 91)), "0 to 90"), (("verse", ["b"]), "b")):
        planned = selection.checked_slice(wide, *asked)  # nothing fails before it is run
        with pytest.raises(Exception, match=said):
            planned.collect()
    with pytest.raises(Exception, match="no rows"):
        selection.checked_slice(wide.where("hook = 'none'"), "hook").collect()
    with pytest.raises(ValueError):
        selection.checked_slice(wide, "bpm")
    one = selection.domain_findings(selection.long_of_section(wide, "hook"), ["b", "q"], (120, 500)).first()
    assert (one.n, one.missing, one.min_bpm, one.max_bpm, one.low_ok, one.high_ok) == (4, ["q"], 120, 120, True, False)


def test_a_section_of_a_wide_catalogue_is_read_alone(spark, small, tmp_path):
    from songloom.plans import queries

    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name in ("training_text", "flt_section", "flt_artists", "flt_bpm_range", "flt_both", "flt_slice", "agg_range", "agg_counts"):
        assert "Expand" not in planned(queries.QUERIES[name](spark, small)), name
    wide_catalogue(spark).write.parquet(str(tmp_path / "wide"))
    plan = planned(selection.long_of_section(spark.read.parquet(str(tmp_path / "wide")), "hook"))
    assert "IsNotNull(hook)" in plan and "verse" not in plan


def test_selection_counts(spark):
    from songloom.operators import aggregates

    df = spark.createDataFrame([("a", "x"), ("a", "Unfinished"), ("b", None), (None, "y")], "artist string, Lyrics string")
    assert tuple(aggregates.selection_counts(df, F.col("Lyrics") == "Unfinished").first()) == (3, 1, 2)
