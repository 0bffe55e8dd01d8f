import pytest
from pyspark.sql import functions as F

from songloom.streaming import incremental, resume

LINKS = "row_idx long, Link string, Artist string"


def pairs(df):
    return [(r.Link, r.Artist) for r in df.orderBy("row_idx").collect()]


def test_resume_links_twice_is_once(spark):
    stored = spark.createDataFrame([(0, "u1", "b"), (1, "Unfinished", "b")], LINKS)
    new = spark.createDataFrame([(0, "u1", "b"), (1, "u2", "b")], LINKS)
    once = resume.resume_links(stored, new)
    assert pairs(once) == [("u1", "b"), ("u2", "b")]
    assert pairs(resume.resume_links(once, new)) == pairs(once)


def test_resume_keeps_null_links(spark):
    stored = spark.createDataFrame([(0, None, "b")], LINKS)
    assert pairs(resume.resume_links(stored, stored.where("false"))) == [(None, "b")]


def lyrics(spark):
    rows = [(0, "a", "t0", "x"), (1, "a", "Unfinished", None), (2, "b", None, None), (3, "b", "t3", None), (4, "c", None, "y")]
    return spark.createDataFrame(rows, "row_idx long, Artist string, Lyrics string, `Song Title` string")


def test_first_lyric_session(spark):
    links = spark.createDataFrame([(0, "u1", "a"), (1, "Unfinished", "b"), (2, None, "c"), (3, "u3", "c")], LINKS)
    begun = resume.first_lyrics(links)
    assert begun.columns == ["row_idx", "Artist", "Link", "Features", "Song Title", "Lyrics"]
    assert sorted((r.row_idx, r.Link, r.Lyrics) for r in begun.collect()) == [(0, "u1", None), (2, None, None), (3, "u3", None)]
    assert sorted(r.row_idx for r in resume.open_lyrics(begun).collect()) == [0, 2, 3]
    read = spark.createDataFrame([(0, "la"), (1, "never asked for")], "row_idx long, Lyrics string")
    filled = resume.resume_lyrics(begun, read)
    assert sorted((r.row_idx, r.Lyrics) for r in filled.collect()) == [(0, "la"), (2, None), (3, None)]
    assert resume.first_lyrics(links.limit(0)).isEmpty()


def test_open_lyrics(spark):
    assert sorted(r.row_idx for r in resume.open_lyrics(lyrics(spark)).collect()) == [2, 3, 4]
    assert resume.open_lyrics(lyrics(spark).where("row_idx = 0")).isEmpty()


def test_resume_lyrics(spark):
    results = spark.createDataFrame([(0, "no", "no"), (2, "t2", "n2"), (4, "t4", None)], "row_idx long, Lyrics string, `Song Title` string")
    rows = resume.resume_lyrics(lyrics(spark), results).orderBy("row_idx").collect()
    assert [(r.row_idx, r.Lyrics, r["Song Title"]) for r in rows] == [(0, "t0", "x"), (2, "t2", "n2"), (3, "t3", None), (4, "t4", "y")]


def test_failed_artists_are_open_again(spark):
    links = spark.createDataFrame([(0, "u", "a"), (1, "u", "b")], LINKS)
    failed = spark.createDataFrame([(0, "b")], "row_idx long, Artist string")
    marked = resume.mark_failed(links, failed, "Link")
    assert pairs(marked) == [("u", "a"), ("u", "b"), ("Unfinished", "b")]
    seeds = spark.createDataFrame([("a",), ("b",)], "artist string")
    work = resume.link_worklist(seeds, marked)
    assert [r[0] for r in work.collect()] == ["b"]


@pytest.mark.parametrize("link, lyric, stage", [("a", "a", "links"), (None, "a", "lyrics"), (None, None, "done")])
def test_stage(spark, link, lyric, stage):
    table = lambda v: spark.createDataFrame([(v,)] if v else [], "artist string")
    assert resume.next_stage(table(link), table(lyric)).first().stage == stage


def test_open_bpms(spark):
    bpms = spark.createDataFrame([("YEEHAW",), ("90",), (None,), ("BOOKMARKED",)], "BPM string")
    assert resume.open_bpms(bpms).count() == 1


@pytest.fixture
def feed(spark, tmp_path):
    rows = [(i, f"u{i % 5}" if i % 7 else "Unfinished", f"a{i % 3}") for i in range(60)]
    for part in range(6):
        df = spark.createDataFrame(rows[part * 10 : part * 10 + 10], LINKS)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows, str(tmp_path / "in"), tmp_path


def two_files(source):
    """Bytes of the two largest files: so much lets two or three in, never all six."""
    from pathlib import Path

    return sum(sorted(f.stat().st_size for f in Path(source).glob("*.parquet"))[-2:])


def first_of_each(rows):
    seen = {}
    for i, link, artist in rows:
        if link != "Unfinished":
            seen.setdefault((link, artist), i)
    return seen


def test_collected_links_over_micro_batches(spark, feed):
    rows, source, base = feed
    table, checkpoint = str(base / "table"), str(base / "checkpoint")
    stream = incremental.link_stream(spark, source, spark.read.parquet(source).schema, bytes_per_batch=two_files(source))
    incremental.collect_links(stream, table, checkpoint)
    assert spark.read.parquet(table).select("batch_id").distinct().count() == 3
    got = {(r.Link, r.Artist) for r in incremental.collected_links(spark, table).collect()}
    assert got == set(first_of_each(rows))
    # Run again without new files, then with a file of known links: nothing changes.
    incremental.collect_links(incremental.link_stream(spark, source, stream.schema), table, checkpoint)
    spark.createDataFrame([(100, "u1", "a1"), (101, "new", "a1")], LINKS).write.mode("append").parquet(source)
    incremental.collect_links(incremental.link_stream(spark, source, stream.schema), table, checkpoint)
    later = {(r.Link, r.Artist): r.row_idx for r in incremental.collected_links(spark, table).collect()}
    assert set(later) == got | {("new", "a1")} and later[("u1", "a1")] < 100
    incremental.compact_links(spark, table, str(base / "compact"))
    assert spark.read.parquet(str(base / "compact")).count() == len(later)


def test_distinct_links_stream(spark, feed):
    rows, source, base = feed
    stream = incremental.link_stream(spark, source, spark.read.parquet(source).schema, bytes_per_batch=two_files(source))
    incremental.run_to_table(incremental.distinct_links(stream.select("Link", "Artist")), str(base / "out"), str(base / "cp"))
    got = sorted(map(tuple, spark.read.parquet(str(base / "out")).collect()))
    assert got == sorted({(link, artist) for _, link, artist in rows})


def test_distinct_links_with_event_time(spark, feed):
    _, source, base = feed
    stream = incremental.link_stream(spark, source, spark.read.parquet(source).schema)
    timed = stream.withColumn("seen", F.timestamp_seconds("row_idx"))
    out = incremental.distinct_links(timed, "seen", "1 hour")
    incremental.run_to_table(out, str(base / "out"), str(base / "cp"))
    rows = spark.read.parquet(str(base / "out")).select("Link", "Artist")
    assert rows.count() == rows.distinct().count() > 0


def test_batches_go_by_bytes(spark, feed):
    """Many small files are one batch; a batch that was cut short is done again with the same result."""
    rows, source, base = feed
    schema = spark.read.parquet(source).schema
    incremental.collect_links(incremental.link_stream(spark, source, schema), str(base / "one"), str(base / "cp1"))
    assert spark.read.parquet(str(base / "one")).select("batch_id").distinct().count() == 1

    table, checkpoint, calls = str(base / "cut"), str(base / "cp2"), []
    plain = incremental.keep_first

    def fails_once(batch, keys, order):
        calls.append(1)
        if len(calls) == 2:  # part of the second batch is there when it ends
            batch.limit(3).write.mode("overwrite").parquet(f"{table}/batch_id=1")
            raise RuntimeError("killed")
        return plain(batch, keys, order)

    stream = incremental.link_stream(spark, source, schema, bytes_per_batch=two_files(source))
    incremental.keep_first = fails_once
    try:
        with pytest.raises(Exception, match="killed"):
            incremental.collect_links(stream, table, checkpoint)
    finally:
        incremental.keep_first = plain
    incremental.collect_links(incremental.link_stream(spark, source, schema, bytes_per_batch=two_files(source)), table, checkpoint)
    got = {(r.Link, r.Artist) for r in incremental.collected_links(spark, table).collect()}
    assert got == set(first_of_each(rows)) and len(calls) == 2


def test_distinct_without_state(spark, tmp_path):
    """Copies are dropped however late they come, over many batches, and the stream holds no state."""
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    seen = set()
    for number in range(12):
        rows = [(i, None if i % 11 == 0 else f"u{(i * 7 + number * 3) % 40}", f"a{i % 2}") for i in range(20)]
        seen |= {(link, artist) for _, link, artist in rows}
        spark.createDataFrame(rows, LINKS).coalesce(1).write.mode("append").parquet(source)
        schema = spark.read.parquet(source).schema
        incremental.collect_distinct(incremental.link_stream(spark, source, schema), table, checkpoint, ["Link", "Artist"])
    stored = spark.read.parquet(table)
    assert stored.select("batch_id").distinct().count() > 3 and not (tmp_path / "cp" / "state").exists()
    assert sorted(map(str, stored.select("Link", "Artist").collect())) == sorted(f"Row(Link={a!r}, Artist={b!r})" for a, b in seen)
