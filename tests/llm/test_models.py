"""Language identification and toxicity: held-out accuracy, what is defined for odd rows, and the label model."""

import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from songloom.llm import langid, toxicity
from songloom.llm.queries import QUERIES

ODD = [
    (900001, None, "en", "a"), (900002, "", None, None), (None, "12 34 !!", "de", "a"), (900003, "é", None, "x"),
    (900003, "é", None, "x"), (900004, "IDIOT! " * 3 + "word " * 30000, "en", "a"),
]


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 0


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")


def test_language(spark, docs):
    rows = {r.doc_id: r.lang for r in docs.collect()}
    got = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(rows) and all(r.held_out == held(r.doc_id) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == rows[r.doc_id] for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark, docs):
    odd = spark.createDataFrame(ODD, docs.schema)
    got = langid.identify(docs.unionByName(odd), reject=False).where("doc_id >= 900000 or doc_id is null").collect()
    assert len(got) == len(ODD)
    assert all((r.lang_pred == "und") == (r.doc_id in (900001, 900002, None)) for r in got)
    assert langid.identify(odd.limit(0)).count() == 0
    nothing = langid.identify(odd.where("lang is null"), reject=False).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = QUERIES["op7_toxicity"](spark, folder).collect()
    out = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.5) for r in got)
    caught = sum(p for p, y in out if y) / max(1, sum(y for _, y in out))
    false = sum(p for p, y in out if not y) / max(1, sum(1 - y for _, y in out))
    print("caught", caught, "false", false)
    assert caught > 0.9 and false < 0.01


def test_toxicity_of_odd_rows(spark, docs):
    odd = spark.createDataFrame(ODD, docs.schema)
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    got = {(r.doc_id, r.predicted) for r in toxicity.toxicity(odd, none).collect()}
    assert got == {(900001, 0), (900002, 0), (None, 0), (900003, 0), (900004, 1)}
    assert toxicity.toxicity(odd.limit(0), none).count() == 0
    left = toxicity.without_toxic(odd, none)
    assert left.columns == odd.columns and left.count() == len(ODD) - 1


def test_toxicity_learns_words_outside_the_driver(spark):
    def most(words):
        text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(words)), lambda x: F.concat_ws("w", "doc_id", x)))
        docs = spark.range(40).withColumnRenamed("id", "doc_id").withColumn("text", text)
        labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
        tracemalloc.start()
        toxicity.trained(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak

    most(10)
    assert most(8000) < most(200) + 2e6


def test_toxicity_lexicon_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        words = [f"w{x}" for x in rng.zipf(1.3, 30) if x < 5000]
        toxic = int(rng.random() < 0.2)
        rows += [(i * 9 + c, " ".join(words + ["Zzvile!", f"grimble{rng.integers(9)}"] * toxic), toxic) for c in range(1 + 2 * (i % 50 == 0))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(7)
    got = toxicity.learned_lexicon(sample := toxicity._sample(docs, 1000), sample.select("row", "toxic").collect())

    texts = [{w.strip("!").lower() for w in text.split()} for _, text, _ in rows]
    toxic = np.array([t for _, _, t in rows])
    seen = Counter(w for words in texts for w in words)
    digest = lambda w: xxhash.xxh3_64_intdigest(w.encode())
    least = [min((digest(w) for w in words if seen[w] <= max(3, len(rows) // 100)), default=("none", i)) for i, words in enumerate(texts)]
    weight = np.array([1 / Counter(least)[x] for x in least])
    base = (weight * toxic).sum() / weight.sum()

    def brute(entries):
        every, found = set().union(*entries), {}
        for e in every:
            held = np.array([e in x for x in entries])
            n, k = (weight * held).sum(), (weight * held * toxic).sum()
            share = min(max(k / n, 1e-9), 1 - 1e-9)
            ratio = k * np.log(share / base) + (n - k) * np.log((1 - share) / (1 - base))
            if share > 0.6 + 1e-9 and k >= 2.5 - 1e-9 and ratio > np.log(len(every)) + 1:
                found[e] = ratio
        return found

    whole = brute([{toxicity.entries_of(w)[0] for w in words} for words in texts])
    rest = brute([{e for w in words if (x := toxicity.entries_of(w))[0] not in whole for e in x[1:]} for words in texts])
    assert whole and rest and got == pytest.approx(whole | rest)


def test_toxicity_sample_is_bounded_with_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "some text")] * 9, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    rows = docs.join(labels, "doc_id")
    assert toxicity._sample(rows, 4).count() == 4 and toxicity._sample(rows, 9).count() == 9
    assert toxicity.toxicity(docs, labels).count() == 9


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(5)
    y = rng.random(4000) < 0.2
    good = np.stack([np.where(rng.random(4000) < 0.9, y, ~y) for _ in range(4)], axis=1)
    poor = rng.random(4000) < 0.3
    votes = np.column_stack([good, poor, poor, poor]).astype(int)
    votes[rng.random(votes.shape) < 0.1] = -1
    votes[:, 0] = good[:, 0]
    posterior, weights = toxicity.label_model(votes, 0.2, anchor=0)
    assert ((posterior > 0.5) == y).mean() > 0.95
    assert weights[4:].max() < weights[:4].min()
