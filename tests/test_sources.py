import pytest
from pyspark.errors import AnalysisException

from songloom import session
from songloom.operators.corpus import prompts, training_examples
from songloom.operators.ordering import with_row_index
from songloom.operators.selection import select_slice, unpivot_sections
from songloom.sources import csv, tables, text


def test_csv_round_trip_with_quotes_breaks_and_nulls(spark, tmp_path):
    rows = [(0, 'say "hi"', "line 1\nline 2"), (1, None, "a,b"), (2, "360", "03"), (3, "None", "NA")]
    df = spark.createDataFrame(rows, "row_idx long, artist string, text string")
    csv.write_csv_indexed(df, str(tmp_path / "t"))
    back = csv.read_csv_indexed(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect())) == rows
    assert back.dtypes == [("row_idx", "bigint"), ("artist", "string"), ("text", "string")]


def test_csv_of_another_writer(spark, tmp_path):
    path = tmp_path / "links.csv"
    path.write_text(',Song Title,Lyrics,Link,Artist\n0,,,https://x/1,360\n3,"a ""b""\nc",NA,https://x/2,03 G\n', encoding="utf-8")
    rows = csv.read_csv_indexed(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [(0, None, None, "https://x/1", "360"), (3, 'a "b"\nc', "NA", "https://x/2", "03 G")]
    from songloom.functions.coercion import NULL_TOKENS

    known = csv.read_csv(spark, str(path), tokens=NULL_TOKENS, row_order="pos")
    assert [r.Lyrics for r in known.orderBy("pos").collect()] == [None, None]


def test_lines_and_corpus(spark, tmp_path):
    path = tmp_path / "seeds.txt"
    path.write_bytes("  Ä b  \r\nC\n\n".encode())
    assert [r.artist for r in text.read_lines(spark, str(path)).collect()] == ["Ä b", "C", ""]
    assert text.read_corpus(spark, str(path)).first().text == "  ä b  \nc\n\n"


@pytest.mark.parametrize("content", ["A\r\nbÄ\n\nc", "a\n", "a", "\n\n", "x\ry\nz\r\n", "line\n" * 5000 + "end"])
def test_corpus_lines_are_the_whole_file(spark, tmp_path, content):
    (tmp_path / "1.txt").write_bytes(content.encode())
    (tmp_path / "2.txt").write_bytes(b"other\n" * 50)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = text.read_corpus_lines(spark, str(tmp_path)).orderBy("row_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = {r.path.rsplit("/", 1)[1]: r.text for r in text.read_corpus(spark, str(tmp_path)).collect()}
    for path in {r.path for r in rows}:
        assert "".join(r.text for r in rows if r.path == path) == whole[path.rsplit("/", 1)[1]]
    assert [r.row_idx for r in rows] == list(range(len(rows)))
    assert len({r.path for r in rows}) == 2


def test_default_table(spark, tmp_path):
    default = tables.empty_table(spark, tables.BPMS_SCHEMA)
    missing = tables.read_or_default(lambda: spark.read.parquet(str(tmp_path / "none")), default)
    assert missing.columns == ["Rappers", "Songs", "BPM"] and missing.isEmpty()
    with pytest.raises(AnalysisException):
        tables.read_or_default(lambda: default.select("nope"), default)


def test_missing_columns_and_initial_bpms(spark):
    df = spark.createDataFrame([(0, "u", "a")], "row_idx long, Link string, Artist string")
    full = tables.with_missing_columns(df, tables.LINKS_SCHEMA)
    assert full.schema.names == tables.LINKS_SCHEMA.names and full.first()["Lyrics"] is None
    songs = spark.createDataFrame([("a", "x, y")], "artist string, title string")
    assert tuple(tables.initial_bpms(songs).first()) == ("a", "x y", "YEEHAW")


@pytest.mark.parametrize("form", ["json", "parquet"])
def test_training_set(spark, tmp_path, form):
    df = spark.createDataFrame([("a\nb",)], "text string")
    tables.write_training_set(df, str(tmp_path / "t"), form)
    assert spark.read.format(form).load(str(tmp_path / "t")).first().text == "a\nb"


class FakeSession:
    """A session whose settings can be chosen; the real one's checkpoint folder is fixed at its start."""

    def __init__(self, master, named=None):
        self.master, self.named, self.folder = master, named, None
        self.conf = self.sparkContext = self

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.named or default

    def getCheckpointDir(self):  # noqa: N802
        return self.folder

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = folder


def test_shared_folder_comes_from_the_session():
    cluster = FakeSession("yarn", "hdfs:///shared/")
    assert session.shared_dir(cluster) == cluster.folder == "hdfs:///shared/"
    assert session.new_dir(cluster, "x").startswith("hdfs:///shared/x-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(FakeSession("yarn"))
    alone = FakeSession("local[2]")
    assert session.shared_dir(alone) == session.shared_dir(alone) == alone.folder


def test_positions_of_csv_rows_follow_the_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("artist,title,bpm,hook\nA,one,90,la\nB,two,,\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("artist,title,bpm,hook\n" + "A,three,100,na\n" * 3, encoding="utf-8")
    wide = with_row_index(csv.read_csv(spark, str(tmp_path), row_order="place"), ["place"]).drop("place")
    assert [(r.row_idx, r.title) for r in wide.orderBy("row_idx").collect()] == [
        (0, "one"), (1, "two"), (2, "three"), (3, "three"), (4, "three"),
    ]
    songs = unpivot_sections(wide, ["row_idx", "artist", "title", "bpm"])
    examples = training_examples(prompts(select_slice(songs, "hook", artists=["A"], bpm_range=(95, 100))))
    assert {r.text for r in examples.collect()} == {"### Question: Write a hook like A\n ### Answer: na"}


@pytest.mark.parametrize("by", ["name", "position"])
def test_catalogue_is_written_in_order(spark, tmp_path, by):
    from songloom.operators import merging

    rows = [(i, None if i % 13 == 0 else f"a{(i * 7) % 5}", f"t, {i % 4}" if i % 3 else None, f"line\n\"{i}\"") for i in range(60)]
    songs = spark.createDataFrame(rows, "row_idx long, artist string, title string, hook string")
    tempos = spark.createDataFrame([(i, a, t and t.replace(",", ""), str(i)) for i, a, t, _ in rows[:40]], "row_idx long, Rappers string, Songs string, BPM string")
    merging.write_catalogue(merging.merged_catalogue(songs, tempos, by), str(tmp_path / "out"), file_rows=7)
    got = merging.read_catalogue(spark, str(tmp_path / "out")).orderBy("place").collect()
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[2] is None, r[2] or "", r[0]))
    assert [(r.place, int(r.row_idx), r.artist, r.title, r.hook) for r in got] == [(p, *r) for p, r in enumerate(order)]
    first = {}
    for i, a, t, _ in rows[:40]:
        first.setdefault((a, t), str(i))
    wanted = [first.get((a, t)) if a and t else None for _, a, t, _ in order] if by == "name" else [str(i) if i < 40 else None for i, *_ in order]
    assert [r.bpm for r in got] == wanted


def test_src_corpus_of_an_artist_is_many_files(spark, tmp_path, monkeypatch):
    """No file holds all of an artist; characters and windows are those of the artist's whole text."""
    from songloom.plans import queries

    songs = [("a" if i % 10 else "b", "Zeile %d\nÄ 😀 " % i + "x" * (i % 300)) for i in range(900)] + [("a-b", "Y" * 50)]
    spark.createDataFrame(songs, "source string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(queries, "CORPUS_FILE_ROWS", 100, raising=False)
    lengths, read = [], text.read_corpus

    def watched(spark, path):
        files = read(spark, path)
        lengths.extend(r.text.count("\n") for r in files.collect())
        return files

    monkeypatch.setattr(text, "read_corpus", watched)
    got = {r.artist: (r.chars, r.windows) for r in queries.src_corpus(spark, str(tmp_path)).collect()}
    chars = {a: sum(len(t) + 1 for s, t in songs if s == a) for a in ("a", "b", "a-b")}
    assert got == {a: (n, -((40 - n) // 3)) for a, n in chars.items()}
    assert sum(lengths) == len(songs) and max(lengths) <= 100
