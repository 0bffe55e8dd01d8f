import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from songloom.operators import corpus, sampling


def expected_windows(text, length, step):
    return [(i, text[i : i + length], text[i + length]) for i in range(0, len(text) - length, step)]


@pytest.mark.parametrize("text, expected", [("abcd", []), ("abcde", [("abcd", "e")]), ("abcdefgh", [("abcd", "e"), ("defg", "h")])])
def test_golden_windows(spark, text, expected):
    df = spark.createDataFrame([(0, text)], "k long, text string")
    got = corpus.windows(df, ["k"], length=4, step=3).orderBy("start").collect()
    assert [(r.sequence, r.next_char) for r in got] == expected


def test_windows_of_random_texts(spark, monkeypatch):
    monkeypatch.setattr(corpus, "SEGMENT", 10)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abÉ\n\U0001f600 ß") for _ in range(rng.choice([0, 1, 4, 5, 9, 40, 133]))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    for length, step in [(4, 3), (4, 1), (1, 1), (3, 7), (12, 5)]:
        got = sorted((r.k, r.start, r.sequence, r.next_char) for r in corpus.windows(df, ["k"], length=length, step=step).collect())
        assert got == sorted((k, *w) for k, t in enumerate(texts) for w in expected_windows(t.lower(), length, step))


def test_windows_of_a_very_long_text(spark):
    text = "".join(random.Random(2).choice("abcdé") for _ in range(100_000))
    df = spark.createDataFrame([(0, text)], "k long, text string")
    got = [(r.start, r.sequence, r.next_char) for r in corpus.windows(df, ["k"]).orderBy("start").collect()]
    assert got == expected_windows(text, 40, 3)


def test_step_one_rebuilds_the_text(spark):
    df = spark.createDataFrame([(0, "hello wörld")], "k long, text string")
    rows = corpus.windows(df, ["k"], length=3, step=1).orderBy("start").collect()
    assert rows[0].sequence + "".join(r.next_char for r in rows) == "hello wörld"


@pytest.mark.parametrize("chunk_rows", [1, 2, 5, 1000])
def test_corpus_windows_cross_texts_and_chunks(spark, chunk_rows):
    rng = random.Random(chunk_rows)
    groups = {g: ["".join(rng.choice("ab\U0001f600É") for _ in range(rng.choice([0, 1, 1, 2, 7]))) for _ in range(rng.randint(0, 25))] for g in "xyz"}
    rows = [(g, i * 3 + ord(g) % 3, t) for g, texts in groups.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "g string, row_idx long, text string").repartition(5)
    for length, step in [(4, 3), (2, 1), (1, 4)]:
        got = corpus.corpus_windows(df, "g", length=length, step=step, chunk_rows=chunk_rows).collect()
        assert sorted((r.g, r.start, r.sequence, r.next_char) for r in got) == sorted(
            (g, *w) for g, texts in groups.items() for w in expected_windows("".join(texts).lower(), length, step)
        )


def test_corpus_windows_golden_and_one_text(spark):
    df = spark.createDataFrame([("g", 0, "abc"), ("g", 1, ""), ("g", 2, "d"), ("g", 3, "efgh")], "g string, row_idx long, text string")
    got = corpus.corpus_windows(df, "g", length=4, step=3).orderBy("start").collect()
    assert [(r.sequence, r.next_char) for r in got] == [("abcd", "e"), ("defg", "h")]
    one = spark.createDataFrame([("g", 0, "abcdefghij")], "g string, row_idx long, text string")
    whole = sorted(map(tuple, corpus.corpus_windows(one, "g", length=4, step=3).collect()))
    assert whole == sorted(map(tuple, corpus.windows(one, ["g"], length=4, step=3).collect()))


@pytest.mark.parametrize("chunk_rows", [1, 3, 1000])
def test_pieces_in_offset_order_are_the_corpus(spark, chunk_rows):
    texts = ["ab", "", "CDE", "f", "gh"]
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)], "g string, row_idx long, text string")
    rows = corpus.corpus_pieces(df, "g", chunk_rows=chunk_rows).orderBy("offset").collect()
    assert "".join(r.text for r in rows) == "abcdefgh"
    assert [r.offset for r in rows] == [0, 2, 5, 6]


def test_vocabulary_and_codes(spark):
    df = spark.createDataFrame([(0, "Cabé")], "k long, text string")
    vocab = corpus.vocabulary(df)
    assert {r.ch: r.idx for r in vocab.collect()} == {"a": 0, "b": 1, "c": 2, "é": 3}
    row = corpus.encoded_windows(df, ["k"], vocab, length=3, step=1).first()
    assert (row.codes, row.label) == ([2, 0, 1], 3)
    assert [r.ch for r in corpus.vocabulary(spark.createDataFrame([("a1 b",)], "text string"), letters_only=True).orderBy("idx").collect()] == ["a", "b"]


def test_codes_decode_to_the_windows(spark, monkeypatch):
    monkeypatch.setattr(corpus, "SEGMENT", 10)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abé\0\U0001f600퟿ 1") for _ in range(rng.choice([0, 3, 5, 60]))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    vocab = corpus.vocabulary(df)
    letters = {r.idx: r.ch for r in vocab.collect()}
    coded = corpus.encoded_windows(df, ["k"], vocab, length=4, step=3).collect()
    decoded = sorted((r.k, r.start, "".join(letters[c] for c in r.codes), letters[r.label]) for r in coded)
    assert decoded == sorted(map(tuple, corpus.windows(df, ["k"], length=4, step=3).collect()))


def test_stand_ins_skip_surrogates(spark):
    many = [chr(c) for c in range(1, 0xD800)] + [chr(c) for c in range(0xE000, 0xE100)]
    df = spark.createDataFrame([("".join(many).lower(),)], "text string")
    vocab = corpus.vocabulary(df)
    row = corpus.encoded_windows(df, [], vocab, length=5, step=1).agg(F.max("label").alias("m")).first()
    assert row.m == vocab.agg(F.max("idx")).first()[0] > 0xD000


def test_one_hot(spark):
    assert spark.range(1).select(corpus.one_hot(F.lit(2), 4)).first()[0] == [False, False, True, False]


def test_prompts_and_examples(spark):
    df = spark.createDataFrame([("hook", "A", "la la")], "section string, artist string, text string")
    qa = corpus.prompts(df)
    assert tuple(qa.first()) == ("Write a hook like A", "la la")
    assert corpus.training_examples(qa).first()[0] == "### Question: Write a hook like A\n ### Answer: la la"


def test_token_cap(spark):
    df = spark.createDataFrame([(" a  b c ",), ("a b",), ("",), ("  ",)], "text string")
    rows = [(r.text, r.n_tokens, r.was_cut) for r in corpus.cap_tokens(df, cap=2).collect()]
    assert rows == [("a b", 3, True), ("a b", 2, False), ("", 0, False), ("  ", 0, False)]


def test_next_char_shares_add_up(spark):
    df = spark.createDataFrame([("abcabd",), ("xabca",)], "text string")
    dist = corpus.next_char_distribution(df, context=2)
    rows = {(r.context, r.ch): (r.n, r.p) for r in dist.collect()}
    assert rows[("ab", "c")] == (2, 2 / 3) and rows[("ab", "d")] == (1, 1 / 3) and rows[("bc", "a")] == (2, 1.0)


@pytest.mark.parametrize("t, expected", [(1, [0.8, 0.2]), (0, [0.8, 0.2]), (0.5, [0.64 / 0.68, 0.04 / 0.68]), (2, [2 / 3, 1 / 3])])
def test_temperature(spark, t, expected):
    dist = spark.createDataFrame([("c", "a", 0.8), ("c", "b", 0.2), ("c", "z", 0.0)], "context string, ch string, p double")
    rows = sampling.rescale(dist, t, ["context"]).orderBy("ch").collect()
    assert [r.p for r in rows] == pytest.approx(expected)


def test_draws_follow_the_distribution_and_any_partitioning_gives_the_same(spark):
    dist = spark.createDataFrame([("c", "a", 0.7), ("c", "b", 0.2), ("c", "d", 0.1)], "context string, ch string, p double")
    first = sampling.draw(dist, 1.0, ["context"], draws=4000, seed=1)
    counts = {r.ch: r["count"] / 4000 for r in first.groupBy("ch").count().collect()}
    assert counts == pytest.approx({"a": 0.7, "b": 0.2, "d": 0.1}, abs=0.03)
    again = sampling.draw(dist.repartition(3), 1.0, ["context"], draws=4000, seed=1)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))


def test_sweep_sharpens_at_low_temperature(spark):
    dist = spark.createDataFrame([("c", "a", 0.7), ("c", "b", 0.3)], "context string, ch string, p double")
    rows = sampling.sweep(dist, ["context"], [0.1, 2.0], draws=500, seed=3).where("ch = 'a'").groupBy("temperature").count().collect()
    share = {r.temperature: r["count"] / 500 for r in rows}
    assert share[0.1] > 0.98 > 0.75 > share[2.0]


def test_one_hot_windows(spark):
    rows = [(1, "abcabca"), (2, "cab"), (3, None), (4, "bbbbbbbbb"), (4, "abcab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = corpus.vocabulary(docs)
    coded = corpus.encoded_windows(docs, ["doc_id"], vocab, length=4, step=2)
    shards = corpus.one_hot_tensors(coded, ["doc_id", "start"], 3, rows=2).collect()
    assert shards and all(s.n <= 2 and s.length == 4 for s in shards)
    got = []
    for s in shards:
        x, y = corpus.tensor_of(s.x, s.n, 4, 3), corpus.tensor_of(s.y, s.n, 3)
        assert (x.sum(2) == 1).all() and (y.sum(1) == 1).all()
        for w, a, b in zip(s.windows, x, y):
            got.append((w.doc_id, w.start, "".join("abc"[c] for c in a.argmax(1)), "abc"[b.argmax()]))
    want = [(i, at, t[at : at + 4], t[at + 4]) for i, t in rows if t for at in range(0, len(t) - 4, 2)]
    assert sorted(got) == sorted(want)
    counts = {}
    for _, _, text, label in want:
        for place, ch in enumerate(text + label):
            counts[place, "abc".index(ch)] = counts.get((place, "abc".index(ch)), 0) + 1
    found = corpus.hot_counts(corpus.one_hot_tensors(coded, ["doc_id"], 3, rows=3), 3).collect()
    assert {(r.place, r.code): r.n for r in found} == counts


def test_null_group_is_a_group(spark):
    rows = [(None, i, f"x{i}") for i in range(9)] + [("a", 9 + i, f"y{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "artist string, row_idx long, text string")
    for ahead in (0, 3):
        placed = corpus.corpus_pieces(df, "artist", lookahead=ahead, chunk_rows=2).collect()
        for artist in (None, "a"):
            mine = sorted((r.offset, r.text) for r in placed if r.artist == artist)
            assert "".join(t for _, t in mine) == "".join(t for a, _, t in rows if a == artist)
            assert [o for o, _ in mine] == list(range(0, 2 * len(mine), 2))
    windows = corpus.corpus_windows(df, "artist", length=4, step=3, chunk_rows=2).where("artist is null").count()
    assert windows == len(range(0, 18 - 4, 3))


def test_one_hot_cells_are_written_and_counted_alone():
    """Cells as ``packbits`` has them, without a byte per cell: a shard over many characters costs its bits, not its cells."""
    import tracemalloc

    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 5, 7, 8, 9, 69, 300):
        for n in (0, 1, 7, 500):
            codes = rng.integers(0, size, n)
            dense = np.zeros((n, size), bool)
            dense[np.arange(n), codes] = True
            assert (np.packbits(dense) == corpus._packed(codes, size)).all()
            assert (np.sort(corpus._hot(corpus._packed(codes, size))) == np.flatnonzero(dense)).all()
    tracemalloc.start()
    codes = rng.integers(0, 3_000, 40 * 256)
    assert len(corpus._hot(corpus._packed(codes, 3_000))) == len(codes)
    assert tracemalloc.get_traced_memory()[1] < 40 * 256 * 3_000 / 2
    tracemalloc.stop()


def test_runs_of_windows_make_the_tensors_that_rows_make(spark, monkeypatch):
    """Windows that follow each other leave the JVM as one row per text, and are opened with their keys where tensors are made."""
    monkeypatch.setattr(corpus, "SEGMENT", 30)
    rng = random.Random(11)
    texts = ["".join(rng.choice("abÉ\n\0\U0001f600 ß1퟿") for _ in range(rng.choice([0, 1, 4, 5, 6, 9, 40, 133]))) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "k long, text string").repartition(2)
    vocab = corpus.vocabulary(docs)
    letters = {r.idx: r.ch for r in vocab.collect()}
    for length, step, rows in [(4, 3, 50), (1, 1, 7), (7, 2, 1024), (12, 5, 3), (3, 9, 64)]:
        runs = corpus.encoded_windows(docs, ["k"], vocab, length=length, step=step, runs=True)
        shards = corpus.one_hot_tensors(runs, ["k", "start"], len(letters), rows=rows, length=length, step=step)
        got = []
        for s in shards.collect():
            x, y = corpus.tensor_of(s.x, s.n, length, len(letters)), corpus.tensor_of(s.y, s.n, len(letters))
            assert s.n == len(s.windows) <= rows and s.length == length and (x.sum(2) == 1).all() and (y.sum(1) == 1).all()
            got += [(w.k, w.start, "".join(letters[c] for c in a.argmax(1)), letters[b.argmax()]) for w, a, b in zip(s.windows, x, y)]
        want = sorted((k, *w) for k, t in enumerate(texts) for w in expected_windows(t.lower(), length, step))
        assert sorted(got) == want
        assert runs.count() < len(want)
        whole = corpus.encoded_windows(docs, ["k"], vocab, length=length, step=step)
        counts = [corpus.hot_counts(t, len(letters)).collect() for t in (shards, corpus.one_hot_tensors(whole, ["k"], len(letters)))]
        assert sorted(counts[0]) == sorted(counts[1]) and sum(r.n for r in counts[0]) == len(want) * (length + 1)


def test_codes_beyond_the_surrogates_in_runs(spark):
    many = [chr(c) for c in range(1, 0xD800)] + [chr(c) for c in range(0xE000, 0xE100)]
    text = "".join(many).lower()
    df = spark.createDataFrame([(text,)], "text string")
    vocab = corpus.vocabulary(df)
    places = {r.ch: r.idx for r in vocab.collect()}
    batch = corpus.encoded_windows(df, [], vocab, length=5, step=1, runs=True).orderBy("start").toArrow().to_batches()[0]
    _, codes, at = corpus._opened(batch.slice(batch.num_rows - 1), [], 5, 1)
    assert [int(c) for c in codes[at[-1] : at[-1] + 6]] == [places[c] for c in text[-6:]]


def test_cells_are_added_up_by_the_byte(monkeypatch):
    """Counts as those of dense tensors, for rows that end within a byte, shards of any number of rows and many carries."""
    rng = np.random.default_rng(4)
    for waiting, row in [(64, 1), (64, 3), (65_536, 65), (256, 65), (64, 8), (256, 12), (256, 2600)]:
        monkeypatch.setattr(corpus, "WAITING", waiting)
        want, levels = np.zeros(row, np.int64), []
        for n in [1, 7, 8, 1000, 333, 3, 64, 1024, 1024]:
            dense = rng.random((n, row)) < rng.random(row)
            want += dense.sum(0)
            corpus._add_cells(levels, np.packbits(dense), row)
        assert (corpus._cell_counts(levels, row) == want).all()
        assert sum(rows.nbytes for rows in levels) <= len(levels) * max(waiting, 32 * row)


def test_cells_of_a_shard_are_let_go():
    import weakref

    cells = corpus._packed(np.arange(7), 7)
    held, seen = corpus._one_value(cells), weakref.ref(cells)
    assert held.to_pylist() == [cells.tobytes()]
    del held, cells
    assert seen() is None


def test_vocabulary_of_odd_texts(spark):
    texts = ["", None, "a\0b", "\U0001f600\U0001f601", "İ", "ΑΣ", "ab" * 5_000, "\n "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    lowered = [r[0] for r in df.select(F.lower("text")).collect() if r[0]]
    want = {ch: place for place, ch in enumerate(sorted({ch for t in lowered for ch in t}))}
    vocab = corpus.vocabulary(df)
    assert {r.ch: r.idx for r in vocab.collect()} == want
    # A code point is marked where it is met; no row is made per character.
    assert "Generate" not in vocab._jdf.queryExecution().executedPlan().toString()
