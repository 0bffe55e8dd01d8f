"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A word in lower case, with marks for its ends, stands for its character n-grams; each n-gram has a row of a hashed
embedding table. A text is the average of all its rows, and a linear softmax over it gives the languages. Table
and softmax are trained together by stochastic gradient descent in numpy, on a bounded sample of labelled texts
(``TRAIN_ROWS``) that tasks have turned into n-gram counts. One part of the sample is kept out of the descent:
on it a temperature makes the scores probabilities, and the score below which a prediction counts as rejected is
set so that the accepted ones have the asked precision.

At prediction table and softmax are one table of scores per n-gram, so a distinct word of a batch is scored once
and a text is a sum over all its words.

Defined cases: a text that is null or has no letter is ``und`` with score 0; labels that are null are not
learned from; with no labelled text every prediction is ``und``; repeated rows get the same result each; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.llm.common import coded, is_held_out, mixed, steps, sums, words_of

#: Labelled texts that are learned from at most.
TRAIN_ROWS = 4000
BUCKETS = 1 << 15
WIDTH = 16
GRAMS = (1, 2, 3, 4)
UNKNOWN = "und"


def grams_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words one after the other, and where each word's start."""
    texts = [f"<{w}>" for w in pc.utf8_lower(words).to_pylist()]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # characters to the word's end
    owner = np.repeat(np.arange(len(texts)), lengths)
    found, owners = [], []
    value = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        shifted = np.zeros(len(points), np.uint64)
        shifted[: len(points) - n + 1] = points[n - 1 :]
        value = mixed(value * np.uint64(31) + shifted + np.uint64(n))
        if n in GRAMS:
            whole = left >= n
            found.append((value[whole] % np.uint64(BUCKETS)).astype(np.int64))
            owners.append(owner[whole])
    buckets, owner = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))
    return buckets[order], starts


def _gram_counts(rows: DataFrame) -> DataFrame:
    """``lang, calibrates, buckets, counts`` per labelled row, made in tasks; the last two as bytes, for the driver's sake."""

    def run(batches):
        for batch in steps(batches, "text"):
            words, starts = words_of(batch.column("text"))
            codes, distinct = coded(words)
            buckets, gram_starts = grams_of(distinct)
            keys, counts = [], []
            for begin, end in zip(starts, starts[1:]):
                used, times = np.unique(codes[begin:end], return_counts=True)
                parts = [buckets[gram_starts[u] : gram_starts[u + 1]] for u in used.tolist()]
                weights = np.repeat(times, [len(p) for p in parts]) if parts else np.zeros(0)
                total = np.bincount(np.concatenate(parts) if parts else np.zeros(0, np.int64), weights, BUCKETS)
                keys.append(np.flatnonzero(total).astype(np.int32))
                counts.append(total[keys[-1]].astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("calibrates"), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([c.tobytes() for c in counts], pa.binary())],
                ["lang", "calibrates", "buckets", "counts"],
            )

    return rows.mapInArrow(run, "lang string, calibrates boolean, buckets binary, counts binary")


def softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return scores / scores.sum(axis=-1, keepdims=True)


def descend(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, rounds: int = 8, rate: float = 0.5, seed: int = 7):
    """Embedding table, softmax weights and bias by stochastic gradient descent, one text at a time."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    weights, bias = rng.normal(0, 0.1, (WIDTH, classes)), np.zeros(classes)
    share = np.bincount([y for _, _, y in examples], minlength=classes) / max(1, len(examples))
    # Rare languages get larger steps, within bounds.
    scale = np.clip(1 / np.maximum(classes * share, 1e-9), 0.2, 5)
    for turn in range(rounds):
        step = rate * (1 - turn / rounds)
        for i in rng.permutation(len(examples)):
            keys, part, label = examples[i]
            mean = part @ table[keys]
            error = softmax(mean @ weights + bias)
            error[label] -= 1
            error *= scale[label]
            back = weights @ error
            weights -= step * np.outer(mean, error)
            bias -= step * 0.1 * error
            table[keys] -= step * 20 * np.outer(part, back)
    return table, weights, bias


def calibrated(scores: np.ndarray, labels: np.ndarray, precision: float) -> tuple[float, float]:
    """Temperature of least log loss, and the least score at which accepted predictions have the precision."""
    best = (np.inf, 1.0)
    for temperature in np.geomspace(0.02, 5, 60):
        p = softmax(scores / temperature)
        loss = -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()
        best = min(best, (loss, float(temperature)))
    p = softmax(scores / best[1])
    top, right = p.max(axis=1), p.argmax(axis=1) == labels
    order = np.argsort(-top)
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision
    threshold = float(top[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return best[1], min(threshold, 0.5) if right.all() else threshold


def train(labelled: DataFrame, precision: float = 0.99, max_rows: int = TRAIN_ROWS) -> dict:
    """Model from ``id, text, lang`` rows. Takes ``max_rows`` rows at most, chosen by a hash of the id and text."""
    by_hash = F.xxhash64("id", F.length("text"))
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # The rows with the smallest hashes: numbers alone are sorted, and texts stay where they are.
    least = rows.select(by_hash.alias("h")).orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    chosen = rows.where(by_hash <= F.lit(least if least is not None else 0))
    calibrates = F.pmod(F.xxhash64(F.lit("calibration"), "id"), F.lit(5)) == 0
    sample = _gram_counts(chosen.select("text", "lang", calibrates.alias("calibrates"))).limit(max_rows).collect()
    langs = sorted({r["lang"] for r in sample})
    data = []
    for r in sample:
        counts = np.frombuffer(r["counts"], np.float32)
        if len(counts):
            data.append((np.frombuffer(r["buckets"], np.int32), counts / counts.sum(), langs.index(r["lang"]), r["calibrates"]))
    if not data:
        return {"langs": [], "scores": np.zeros((BUCKETS, 1)), "bias": np.zeros(1), "temperature": 1.0, "accept": 1.0}
    learned = [d[:3] for d in data if not d[3]] or [d[:3] for d in data]
    table, weights, bias = descend(learned, len(langs))
    scores = table @ weights
    held = [d for d in data if d[3]] or data
    raw = np.array([part @ scores[keys] + bias for keys, part, _, _ in held])
    temperature, accept = calibrated(raw, np.array([d[2] for d in held]), precision)
    return {"langs": langs, "scores": scores.astype(np.float32), "bias": bias, "temperature": temperature, "accept": accept}


def predict(docs: DataFrame, model: dict, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, ``lang_pred``, ``score`` and whether the score is high enough to be ``accepted``."""
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the table of n-gram scores, which is fixed

    def run(batches):
        known = shared.value
        names = np.array([*known["langs"], UNKNOWN], object)
        for batch in steps(batches, "text"):
            words, starts = words_of(batch.column("text"))
            codes, distinct = coded(words)
            buckets, gram_starts = grams_of(distinct)
            per_word = sums(known["scores"][buckets].astype(float), gram_starts)
            grams = np.diff(gram_starts).astype(float)
            letters = pc.match_substring_regex(distinct, r"\p{L}").to_numpy(zero_copy_only=False)
            total = sums(per_word[codes], starts)
            n = np.maximum(sums(grams[codes], starts), 1)
            usable = (sums(letters[codes].astype(np.int64), starts) > 0) & bool(len(known["langs"]))
            p = softmax((total / n[:, None] + known["bias"]) / known["temperature"])
            best = np.where(usable, p.argmax(axis=1), len(known["langs"]))
            score = np.where(usable, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names[best], pa.string()), pa.array(score), pa.array(usable & (score >= known["accept"]))],
                ["id", "lang_pred", "score", "accepted"],
            )

    narrow = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, lang_pred string, score double, accepted boolean").withColumnRenamed("id", id_column)


def identify(
    docs: DataFrame, precision: float = 0.99, max_rows: int = TRAIN_ROWS, reject: bool = True,
    id_column: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """Language of every text, learned from the rows that are not held out. With ``reject``, unsure ones are ``und``."""
    labelled = docs.where(~is_held_out(id_column)).select(
        F.col(id_column).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    found = predict(docs, train(labelled, precision, max_rows), id_column, text)
    if reject:
        found = found.withColumn("lang_pred", F.when(F.col("accepted"), F.col("lang_pred")).otherwise(UNKNOWN))
    return found.withColumn("held_out", is_held_out(id_column))
