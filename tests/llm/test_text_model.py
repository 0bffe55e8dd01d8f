"""Context-tree weighting against a recursion over the counts, in chunks and buckets of any size."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from songloom.llm import text_model
from songloom.llm import context_trees, text_model


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, depth):
    """Scores by the definition: weighted probabilities by recursion, predictions as ratios of them."""
    counts = Counter()

    def symbols(text):
        flat = b"\xff" * depth + lower(text).encode() + b"\xff"
        return [(flat[i - depth : i], flat[i]) for i in range(depth, len(flat))]

    def steps(byte):
        return [((1 << b) | (byte >> (8 - b)), (byte >> (7 - b)) & 1) for b in range(8)]

    for doc_id, text in rows:
        if not held_out(doc_id):
            for context, byte in symbols(text):
                for node, bit in steps(byte):
                    for d in range(depth + 1):
                        counts[context[depth - d :], node, bit] += 1
    longer = {}
    for context, node, _ in counts:
        if context:
            longer.setdefault((context[1:], node), set()).add(context)

    def estimate(n0, n1):
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)

    def weighted(context, node, more=None):
        """Logarithm; with ``more`` as (full context, bit) after one more decision there."""
        n = [counts[context, node, 0], counts[context, node, 1]]
        if more:
            n[more[1]] += 1
        if len(context) == depth:
            return estimate(*n)
        below = set(longer.get((context, node), ()))
        nextone = more[0][depth - len(context) - 1 :] if more else None
        if more:
            below.add(nextone)
        product = sum(weighted(c, node, more if c == nextone else None) for c in below)
        return float(np.logaddexp(estimate(*n), product)) - math.log(2)

    known = {}

    def chance(context, byte):
        if (context, byte) not in known:
            known[context, byte] = sum(weighted(b"", node, (context, bit)) - weighted(b"", node) for node, bit in steps(byte))
        return known[context, byte]

    words = Counter(w for i, t in rows if not held_out(i) for w in [*lower(t).encode().split(), None])
    total, kinds = sum(words.values()), len(words)
    out = []
    for doc_id, text in rows:
        tokens = [*lower(text).encode().split(), None]
        base = sum(math.log10((words[t] + 1) / (total + kinds + 1)) for t in tokens)
        score = sum(chance(*s) for s in symbols(text)) / math.log(10)
        out.append((doc_id, held_out(doc_id), len(tokens), sum(words[t] > 0 for t in tokens), total, base, score))
    return out


ROWS = [
    (0, "The cat sat on the mat."), (1, "the cat\tsat ON the\nhat"), (2, None), (3, ""), (4, " \n "), (5, "été ÉTÉ où"), (6, "aaaaaaaaaaaaaaaa"),
    (7, "the cat sat on the mat."), (7, "a repeated id"), (None, "no id"), (8, "the hat"), (9, "a cat"), (10, "on the mat the cat"),
    (11, "xyz"), (12, "the mat"), (13, "cat"),
]


def check(got, want):
    order = lambda r: (str(r[0]), r[5], r[6])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=order)
    want = sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-10, atol=1e-9)


@pytest.mark.parametrize("depth, shared", [(3, 1), (2, 2), (4, 3)])
def test_scores(spark, monkeypatch, depth, shared):
    monkeypatch.setattr(text_model, "LEAST_BUCKETS", 3)
    assert any(held_out(i) for i, _ in ROWS) and not all(held_out(i) for i, _ in ROWS)
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in ROWS], "doc_id long, text string, score double").repartition(2)
    got = text_model.score_texts(docs, depth=depth, shared=shared, chunk_bytes=40)
    check(got.collect(), brute(ROWS, depth))
    assert all(abs(r.bits_per_byte + r.score / math.log10(2) / (len((next(t for i, t in ROWS if i == r.doc_id) or "").encode()) + 1)) < 1e-9
               for r in got.collect() if r.doc_id not in (7, None))


def test_no_training_and_empty(spark):
    other = [i for i in range(60) if held_out(i)][:2]
    docs = spark.createDataFrame([(i, "ab c") for i in other], "doc_id long, text string")
    for r in text_model.score_texts(docs).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and abs(r.score - 5 * 8 * math.log10(0.5)) < 1e-9 and r.base_score == 0
    assert text_model.score_texts(docs.limit(0)).count() == 0


def test_long_text_in_pieces():
    text = bytes(np.random.default_rng(1).integers(97, 123, 5_000_000, dtype=np.uint8))
    parts = list(text_model.codes_of([b"ab", text, b""], 4))
    assert len(parts) > 2
    codes = np.concatenate([c for c, _ in parts])
    number = np.concatenate([n for _, n in parts])
    assert np.bincount(number).tolist() == [3, 5_000_001, 1]
    flat = np.frombuffer(b"\xff" * 4 + text + b"\xff", np.uint8).astype(np.int64)
    want = sum(flat[4 - b : len(flat) - b] << (8 * (4 - b + 1) if b else 0) for b in range(5))
    assert (codes[3:-1] == want).all()


def test_chances_sum_to_one():
    rng = np.random.default_rng(2)
    seen = np.unique(rng.integers(0, 4, (300, 3)) @ np.array([65536, 256, 1]))
    contexts = np.unique(seen >> 8)
    codes = np.concatenate([(c << 8) + np.arange(256) for c in contexts])
    counts = np.where(np.isin(codes, seen), rng.integers(1, 9000, len(codes)), 0)
    levels = context_trees.lifted(codes, counts, 2, 0)
    logs = context_trees.log_chances(levels, [np.ones(len(k)) for k in levels[-1].keys], [np.zeros(len(k)) for k in levels[-1].keys])
    assert np.allclose(np.exp(logs).reshape(-1, 256).sum(1), 1)


def test_a_chunk_holds_its_answers_once():
    """While the texts of a chunk are scored, the parts its answers came in are gone."""
    import pyarrow as pa

    depth, held = 5, []
    own = np.concatenate([code for code, _ in text_model.codes_of([b""], depth)])
    keys = np.unique(np.concatenate([np.random.default_rng(1).integers(0, 1 << 48, 200_000), own]))
    first = [text_model.packed(key=pa.array(part), value=pa.array(np.full(len(part), -0.5))) for part in np.array_split(keys, 4)]
    docs = text_model.packed(id=pa.array([1]), other=pa.array([False]), text=pa.array([""], pa.large_string()))

    def batches():
        for blob, is_first in [(b, True) for b in first] + [(docs, False)] * 3:
            held.append(pa.total_allocated_bytes())
            yield pa.RecordBatch.from_arrays([pa.array([7]), pa.array([blob], pa.binary()), pa.array([is_first])], ["chunk", "blob", "first"])

    scores = [b.column("score")[0].as_py() for b in text_model._scored(depth, 10, 5, 2)(batches())]
    assert scores == [-0.5] * 3
    assert held[-1] - held[0] < 1.5 * 16 * len(keys)


def test_texts_are_worked_on_in_small_pieces(monkeypatch):
    """Arrays made while texts are cut, weighed and scored stay small beside a table of all their codes."""
    import tracemalloc

    import pyarrow as pa
    import pyspark

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    def peak(call):
        tracemalloc.start()
        try:
            return call(), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    monkeypatch.setattr(pyspark, "TaskContext", Task)
    depth, size = 5, 3 << 20
    text = b"".join(b"%d-%d " % (i % 89, i % 97) for i in range(size // 6)).decode()
    docs = [pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text]), pa.array([False])], ["id", "text", "other"])]
    cut, most = peak(lambda: list(text_model._chunks(depth, 32 << 20)(docs)))
    assert most < 12 * size

    blobs = {b.column("kind")[0].as_py(): b.column("keys")[0].as_py() for b in cut if b.column("keys")[0].is_valid}
    tables = [text_model.unpacked(blobs[k]) for k in (0, 1)]
    found, n = np.unique(np.concatenate([c for c, _ in text_model.codes_of([text.encode()], depth)]), return_counts=True)
    assert tables[0]["key"].to_pylist() == found.tolist() and tables[0]["n"].to_pylist() == n.tolist()
    words = Counter(text.split())
    assert dict(zip(tables[1]["key"].to_pylist(), tables[1]["n"].to_pylist())) == words

    rows = [(text_model.packed(key=t["key"].chunk(0), value=pa.array(np.full(len(t), v))), True) for t, v in zip(tables, (-0.5, 9.0))]
    rows.append((cut[0].column("docs")[0].as_py(), False))
    stream = [pa.RecordBatch.from_arrays([pa.array([7]), pa.array([b], pa.binary()), pa.array([f])], ["chunk", "blob", "first"]) for b, f in rows]
    scored, most = peak(lambda: list(text_model._scored(depth, 99, 0, 2)(stream)))
    assert most < 30 * size
    score, known, base = (scored[0].column(c)[0].as_py() for c in ("score", "n_known", "base_score"))
    assert (score, known) == (-0.5 * (len(text) + 1), words.total() + 1)
    assert math.isclose(base, words.total() * math.log10(10 / 100) + math.log10(3 / 100))
