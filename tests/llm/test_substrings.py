"""Repeated passages against brute force, over several chunks and buckets."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from songloom.llm.substrings import Chunk, remove_repeats


def brute(rows, length):
    words = [(t or "").encode().split() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), []
    for i in order:
        gone = [False] * len(words[i])
        for p in range(len(words[i]) - length + 1):
            key = tuple(words[i][p : p + length])
            if key in seen:
                gone[p : p + length] = [True] * length
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words[i], gone) if not g)
        out.append((rows[i][0], len(words[i]), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 30)}é"
    passage = [word() for _ in range(70)]
    rows = [(0, None), (1, ""), (None, " ".join(passage)), (3, "a " * 55), (4, "\t\n")]
    for i in range(120):
        text = [word() for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            a, at = rng.randrange(60), rng.randint(0, len(text))
            text[at:at] = passage[a : a + rng.randint(3, 50)]
        rows.append((10 + i, rng.choice([" ", "  ", "\n"]).join(text)))
    rows += [(1000 + i, rows[20][1]) for i in range(30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("length,first,size", [(20, 5, 2000), (20, 5, 1 << 20), (7, 3, 3000), (12, 12, 3000)])
def test_against_brute_force(spark, length, first, size):
    rows = made(length + first)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_words string")
    got = remove_repeats(docs.repartition(3), length, first, keep_text=True, chunk_bytes=size, bucket_windows=500)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, length)


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id int, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, remove_repeats(docs).collect())) == [(1, 3, 0, hashlib.sha256(b"a b c").hexdigest()), (2, 0, 0, empty)]
    assert remove_repeats(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a " * 20), (1, "a " * 20)], "doc_id long, text string")
    assert sorted(r.n_removed for r in remove_repeats(twice).collect()) == [0, 20]


def test_window_hashes_tell_words_apart():
    chunk = Chunk(pa.array(["a b c d e f g a b c d e f g", "b a c", "a b c d e f g"]))
    for length in (1, 2, 3, 5, 6, 7):
        value = chunk.windows(length)
        words = [w for t in ("a b c d e f g a b c d e f g", "b a c", "a b c d e f g") for w in t.split()]
        for i in np.flatnonzero(chunk.left >= length):
            for j in np.flatnonzero(chunk.left >= length):
                assert (value[i] == value[j]) == (words[i : i + length] == words[j : j + length])
