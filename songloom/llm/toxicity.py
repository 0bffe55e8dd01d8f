"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posterior labels.

Voters. Some hold a lexicon: a fixed one of plain insults, and others of words and word beginnings that the
labelled sample shows in toxic texts far more often than in others. Some hold a pattern: shouting, runs of
exclamation marks, masked words. They say toxic or nothing; one more voter
says clean where no lexicon has a find.

Label model. Expectation maximisation estimates how accurate each voter is in texts of either class. The given
labels are one voter more, from which the estimate starts and which may be wrong like any other. Voters that
agree more than their accuracies explain are correlated, and share their weight accordingly.

Classifier. A logistic model of the lexicon entries and voters present in a text learns the posterior labels of
the label model; the labels of the sample then place its scores so that 0.5 separates the classes best.

Labels and voters are learned from a bounded sample (``TOXIC_ROWS`` and ``CLEAN_ROWS``), chosen by hashes among the
labelled rows that are not held out. Its texts are counted and looked up in tasks, however long they are; the driver
gets a few numbers and the finds of each text, and the entries that stand out. Scores cover every word of every
text; a distinct word of a batch is looked up once.

Defined cases: a null or empty text is scored like one in which nothing was found; labels that are null, or not 0
or 1, are not learned from; a document with several labels counts with the highest; without labels only the
fixed lexicon and the patterns speak; repeated rows get the same score; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from songloom.llm.common import coded, hashes_of, is_held_out, ragged, steps, sums, words_of
from songloom.session import stored

#: Labelled rows of each class that are learned from at most.
TOXIC_ROWS = 2000
CLEAN_ROWS = 6000
#: Plain insults of the starting lexicon.
INSULTS = (
    "asshole bastard clown coward creep cretin dumb disgusting fool freak garbage idiot imbecile jerk loser lunatic "
    "moron pathetic pig scum stupid trash ugly vermin worthless"
).split()
#: Word beginnings of these lengths are lexicon entries, and 0 for whole words.
STEMS = (0, 3, 4, 5, 6, 7, 8)
BITS = 59
#: Weight 1 as a whole number, so that sums are exact in any order; copies of up to 30 texts divide it evenly.
UNIT = math.lcm(*range(1, 31))
#: Bytes of distinct words whose entries are counted at a time.
WORD_BYTES = 1 << 20
#: Numbers of different words with a find from which a text counts as having several.
TIERS = (2, 4)
MASKED = re.compile(r"[^\W\d_][*@#$]{2,}[^\W\d_]")


def _bare(words: pa.Array) -> list[str]:
    """Lower case, without what is no letter or digit at the ends."""
    trimmed = pc.replace_substring_regex(words, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return pc.utf8_lower(trimmed).to_pylist()


def entries_of(word: str) -> list[int]:
    """Hashed lexicon entries of a bare word: kind in the low bits."""
    import xxhash

    if not word:
        return []
    found = []
    for kind, length in enumerate(STEMS):
        if length == 0 or len(word) > length:
            stem = word[:length] if length else word
            found.append((xxhash.xxh3_64_intdigest(stem.encode(), kind) & ((1 << BITS) - 1)) << 3 | kind)
    return found


def pattern_votes(words: pa.Array, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Votes of the pattern voters per text: shouting, exclamations, masked words; 1 or -1 for nothing."""
    n = np.maximum(np.diff(starts), 1)
    held = words.to_pylist()
    shouted = np.fromiter((len(w) > 2 and w.isupper() for w in held), np.int64, len(held))
    exclaimed = np.fromiter(("!!" in w for w in held), np.int64, len(held))
    hidden = np.fromiter((bool(MASKED.search(w)) for w in held), np.int64, len(held))
    counts = [sums(x[codes], starts) for x in (shouted, exclaimed, hidden)]
    spoken = np.stack([(counts[0] >= 5) & (counts[0] > 0.3 * n), counts[1] >= 2, counts[2] >= 2], axis=1)
    return np.where(spoken, 1, -1)


def sampled(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``toxic, words, distinct, votes`` of texts: how many words, the distinct bare ones, the patterns' votes."""
    words, starts = words_of(batch.column("text"))
    codes, distinct = coded(words)
    bare = _bare(distinct)
    held = [" ".join(sorted({bare[u] for u in np.unique(codes[i:j]).tolist()})) for i, j in zip(starts, starts[1:])]
    votes = pattern_votes(distinct, codes, starts).tolist()
    return pa.RecordBatch.from_arrays(
        [batch.column("toxic"), pa.array(np.diff(starts)), pa.array(held, pa.string()), pa.array(votes, pa.list_(pa.int64()))],
        ["toxic", "words", "distinct", "votes"],
    )


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """Table of the sampled texts, numbered by ``row``; of more than ``most``, which only repeated ids make, the first."""

    def run(batches):
        for batch in steps(batches, "text"):
            yield sampled(batch)

    found = rows.mapInArrow(run, "toxic int, words long, distinct string, votes array<long>")
    sample = stored(found.withColumn("row", F.monotonically_increasing_id()), "toxicity-sample")
    if sample.count() > most:
        sample = sample.join(F.broadcast(sample.select("row").orderBy("row").limit(most)), "row")
    return sample


def copy_weights(sample: DataFrame, rows: list[int]) -> dict[int, int]:
    """``UNIT`` over the number of texts that look like copies of a text: those with the same smallest-hashed rare word."""

    def run(batches):
        for batch in steps(batches, "distinct", WORD_BYTES):
            words, starts = words_of(batch.column("distinct"))
            codes, distinct = coded(words)
            keys = (hashes_of(distinct) ^ np.uint64(1 << 63)).view(np.int64)  # in the order of the unsigned ones
            row = np.repeat(batch.column("row").to_numpy(), np.diff(starts))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(keys[codes])], ["row", "word"])

    held = sample.select("row", "distinct").mapInArrow(run, "row long, word long").groupBy("word").agg(F.collect_list("row").alias("rows"))
    rare = held.where(F.size("rows") <= max(3, len(rows) // 100)).select("word", F.explode("rows").alias("row"))
    least = {r["row"]: r["least"] for r in rare.groupBy("row").agg(F.min("word").alias("least")).collect()}
    groups = Counter(least.values())
    return {row: UNIT // groups[least[row]] if row in least else UNIT for row in rows}


def entry_sums(sample: DataFrame, weight: dict[int, int], known: set[int] | None = None) -> DataFrame:
    """``entry, n, k``: weights of the texts with an entry, and of the toxic ones among them.

    Entries are whole words; with ``known``, the beginnings of the words that are not in it.
    """
    shared = sample.sparkSession.sparkContext.broadcast((weight, known))  # bounded by the sample's rows and the lexicon

    def run(batches):
        weight, known = shared.value
        for batch in steps(batches, "distinct", WORD_BYTES):
            words, starts = words_of(batch.column("distinct"))
            codes, distinct = coded(words)
            every = [entries_of(w) for w in distinct.to_pylist()]
            every = [e[:1] if known is None else e[1:] if e[0] not in known else [] for e in every]
            lengths = np.fromiter(map(len, every), np.int64, len(every))
            flat = np.fromiter((x for e in every for x in e), np.int64, int(lengths.sum()))
            entry = flat[ragged((np.cumsum(lengths) - lengths)[codes], lengths[codes])]
            text = np.repeat(np.repeat(np.arange(len(batch)), np.diff(starts)), lengths[codes])
            order = np.lexsort((text, entry))
            entry, text = entry[order], text[order]
            once = np.ones(len(entry), bool)
            once[1:] = (entry[1:] != entry[:-1]) | (text[1:] != text[:-1])
            entry, text = entry[once], text[once]
            if not len(entry):
                continue
            n = np.array([weight[row] for row in batch.column("row").to_pylist()], np.int64)
            k = n * batch.column("toxic").to_numpy()
            first = np.flatnonzero(np.append(True, entry[1:] != entry[:-1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(entry[first]), pa.array(np.add.reduceat(n[text], first)), pa.array(np.add.reduceat(k[text], first))],
                ["entry", "n", "k"],
            )

    found = sample.select("row", "toxic", "distinct").mapInArrow(run, "entry long, n long, k long")
    return found.groupBy("entry").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def standing_out(counts: DataFrame, base: float) -> dict[int, float]:
    """Entries that stand out in toxic texts, and by how much.

    The measure is the log-likelihood ratio of the toxic share among the texts with the entry against the share
    in all texts. It must exceed the logarithm of the number of entries looked at, so that what stands out by
    chance alone is not taken in.
    """
    counts = stored(counts, "toxicity-entries")
    every = counts.count()
    n, k = F.col("n") / UNIT, F.col("k") / UNIT
    share = F.greatest(F.least(k / n, F.lit(1 - 1e-9)), F.lit(1e-9))
    ratio = k * F.log(share / base) + (n - k) * F.log((1 - share) / (1 - base))
    chosen = (share > 0.6) & (k >= 2.5) & (F.col("ratio") > math.log(max(every, 1)) + 1)
    return {r["entry"]: r["ratio"] for r in counts.withColumn("ratio", ratio).where(chosen).select("entry", "ratio").collect()}


def learned_lexicon(sample: DataFrame, marks: list[Row]) -> dict[int, float]:
    """Whole words that stand out in toxic texts, and beginnings of the words that do not stand out as such."""
    weight = copy_weights(sample, [r["row"] for r in marks])
    share = sum(weight[r["row"]] for r in marks if r["toxic"]) / sum(weight.values())
    base = min(max(share, 1e-3), 0.999)
    found = standing_out(entry_sums(sample, weight), base)
    return found | standing_out(entry_sums(sample, weight, set(found)), base)


def finds_of(sample: DataFrame, place: dict[int, int], strength: np.ndarray) -> DataFrame:
    """``row, present, times``: places of the lexicon entries of a text, and how many of its words have one."""
    shared = sample.sparkSession.sparkContext.broadcast((place, strength))

    def run(batches):
        for batch in steps(batches, "distinct", WORD_BYTES):
            words, starts = words_of(batch.column("distinct"))
            codes, distinct = coded(words)
            entry = np.array([max(found_in([w], *shared.value), default=-1) for w in distinct.to_pylist()], np.int64)
            finds = [x[x >= 0] for x in np.split(entry[codes], starts[1:-1])]
            present, times = pa.array([np.unique(x) for x in finds], pa.list_(pa.int64())), pa.array([len(x) for x in finds], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), present, times], ["row", "present", "times"])

    return sample.select("row", "distinct").mapInArrow(run, "row long, present array<long>, times long")


def voter_of(entry: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Which voter holds an entry: the fixed lexicon is the first; of each kind of learned entries there are two."""
    kind, half = entry & 7, (entry >> 3) & 1
    return np.where(np.isin(entry, fixed), 0, 1 + 2 * kind + half)


def label_model(votes: np.ndarray, prior: float, anchor: int | None = None, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the toxic class per row, and the voters' weights; votes are 1, 0 or -1 for nothing.

    How often a voter says toxic or clean in texts of either class is estimated together with the classes. A vote
    counts with its log odds, silence with nothing. A voter's weight is one over the sum of its residual
    correlations with all voters, so voters that say the same share one voice.
    """
    says1, says0 = (votes == 1).astype(float), (votes == 0).astype(float)
    posterior = 0.1 + 0.8 * (says1 + 0.5 * (1 - says0 - says1)).mean(1) if anchor is None else 0.05 + 0.9 * votes[:, anchor]
    weights = np.ones(votes.shape[1])
    share = min(max(prior, 0.01), 0.5)
    for turn in range(rounds):
        p, q = posterior[:, None], 1 - posterior[:, None]
        rate = lambda said, w: ((w * said).sum(0) + 0.1) / (w.sum(0) + 1)
        toxic1, clean1, toxic0, clean0 = rate(says1, p), rate(says1, q), rate(says0, p), rate(says0, q)
        # A voter may be useless, but is never taken to mean the opposite of what it says.
        toxic1, clean0 = np.maximum(toxic1, clean1), np.maximum(clean0, toxic0)
        if turn == rounds // 2:
            rest = says1 - (p * toxic1 + q * clean1)
            spread = np.sqrt((rest**2).sum(0))
            related = (rest.T @ rest) / np.maximum(np.outer(spread, spread), 1e-9)
            related = np.where(related > 0.2, related, 0)
            np.fill_diagonal(related, 1)
            weights = 1 / related.sum(axis=0)
        evidence = says1 * np.log(toxic1 / clean1) + says0 * np.log(toxic0 / clean0)
        odds = (evidence * weights).sum(1) + np.log(share / (1 - share))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        share = min(max(float(posterior.mean()), 0.01), 0.5)
    return posterior, weights


def logistic(rows: list[np.ndarray], target: np.ndarray, size: int, ridge: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic model on the presence of features, by Newton steps."""
    x = np.zeros((len(rows), size + 1), np.float32)
    x[:, size] = 1
    for i, row in enumerate(rows):
        x[i, row] = 1
    penalty = np.full(size + 1, ridge)
    penalty[size] = 1e-3
    w = np.zeros(size + 1)
    w[size] = -2
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + penalty * w
        bend = (x.T * np.maximum(p * (1 - p), 1e-4)) @ x + np.diag(penalty)
        move = np.linalg.solve(bend, slope)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-4:
            break
    return np.maximum(w[:size], 0), float(w[size])  # a find can only speak for toxic


def placed(scores: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Cut with the fewest errors on labels (the middle of the gap), and the slope around it."""
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], toxic[order]
    errors = np.concatenate(([0], np.cumsum(y))) + np.concatenate((np.cumsum((1 - y)[::-1])[::-1], [0]))
    inside = np.concatenate(([True], s[1:] > s[:-1], [True]))
    errors = np.where(inside, errors, len(s) + 1)
    k = int(np.argmin(errors))
    low = s[k - 1] if k else s[0] - 1
    high = s[k] if k < len(s) else s[-1] + 1
    return float((low + high) / 2), float(min(4.0, 4.0 / max(high - low, 0.5)))


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> dict:
    """Model from documents ``id, text`` and labels ``id, toxic``, both without held-out rows."""
    marked = labels.where(F.col("toxic").isin(0, 1)).groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    by_hash = F.xxhash64(F.lit("sample"), "id")
    # Bounded by the two parameters, so the join side is small whatever the number of labels.
    chosen = marked.where(F.col("toxic") == 1).orderBy(by_hash, "id").limit(toxic_rows).unionByName(
        marked.where(F.col("toxic") == 0).orderBy(by_hash, "id").limit(clean_rows)
    )
    rows = docs.join(F.broadcast(chosen), "id").where(F.col("text").isNotNull()).select("toxic", "text")
    return fit(_sample(rows, toxic_rows + clean_rows))


def fit(sample: DataFrame) -> dict:
    """Model from a table of sampled texts ``row, toxic, words, distinct, votes``."""
    marks = sorted(sample.select("row", "toxic", "words", "votes").collect(), key=lambda r: r["row"])
    toxic = np.array([r["toxic"] for r in marks], int)
    fixed = np.array([entries_of(w)[0] for w in INSULTS])
    strength = dict.fromkeys(fixed.tolist(), 1.0) | (learned_lexicon(sample, marks) if marks else {})
    held = np.array(sorted(strength), np.int64)
    strength = np.array([strength[e] for e in held.tolist()])
    place = {e: i for i, e in enumerate(held.tolist())}
    finds = {r["row"]: (np.array(r["present"], np.int64), r["times"]) for r in finds_of(sample, place, strength).collect()} if marks else {}
    present, times = [finds[r["row"]][0] for r in marks], [finds[r["row"]][1] for r in marks]
    lexicons = 1 + 2 * len(STEMS)
    voter = voter_of(held, fixed)
    votes = np.full((len(marks), lexicons + 5), -1)
    votes[:, lexicons + 4] = toxic
    for i, row in enumerate(present):
        votes[i, voter[row]] = 1
        votes[i, lexicons : lexicons + 3] = marks[i]["votes"]
        if not len(row) and marks[i]["words"] >= 5:  # shorter ones are not called clean for want of a find
            votes[i, lexicons + 3] = 0
    model = {"entries": held, "strength": strength}
    if not marks:
        return model | {"weights": np.append(np.full(len(held), 3.0), [1.0] * (3 + len(TIERS))), "bias": -1.5, "cut": 0.0, "slope": 1.0}
    posterior, _ = label_model(votes, float(toxic.mean()), lexicons + 4)
    spoken = votes[:, lexicons : lexicons + 3] == 1
    rows = [
        np.concatenate([row, len(held) + np.flatnonzero(v), len(held) + 3 + np.flatnonzero(n >= np.array(TIERS))]).astype(int)
        for row, v, n in zip(present, spoken, times)
    ]
    weights, bias = logistic(rows, posterior, len(held) + 3 + len(TIERS))
    scores = np.array([weights[r].sum() + bias for r in rows])
    cut, slope = placed(scores, toxic)
    unseen = np.isin(np.arange(len(weights)), np.concatenate(rows)) | (np.arange(len(weights)) >= len(held))
    weights = np.where(unseen, weights, np.median(weights[: len(held)]))  # insults the sample does not show
    return model | {"weights": weights, "bias": bias, "cut": cut, "slope": slope}


def found_in(words: list[str], place: dict[int, int], strength: np.ndarray) -> set[int]:
    """Places of the lexicon entries of a text's words; of several entries of a word the strongest counts."""
    found = set()
    for word in words:
        known = [place[e] for e in entries_of(word) if e in place]
        if known:
            found.add(max(known, key=lambda i: (strength[i], i)))
    return found


def scorer(model: dict):
    """Function from an array of texts to their scores."""
    place = {e: i for i, e in enumerate(model["entries"].tolist())}

    def scores(texts: pa.Array) -> np.ndarray:
        words, starts = words_of(texts)
        codes, distinct = coded(words)
        finds = {}
        bare = _bare(distinct)
        for u, word in enumerate(bare):
            found = found_in([word], place, model["strength"])
            if found:
                finds[u] = found
        marked = np.zeros(len(distinct) + 1, bool)
        marked[list(finds)] = True
        at = np.flatnonzero(marked[codes])
        row_of = np.searchsorted(starts, at, side="right") - 1
        present: dict[int, set] = {}
        for i, k in zip(row_of.tolist(), codes[at].tolist()):
            present.setdefault(i, set()).add(k)
        weights, patterns = model["weights"], len(place) + 3
        total = np.full(len(texts), model["bias"])
        for i, words_found in present.items():
            total[i] += weights[sorted({e for k in words_found for e in finds[k]})].sum()
            total[i] += weights[patterns:][len({bare[k] for k in words_found}) >= np.array(TIERS)].sum()
        total += (pattern_votes(distinct, codes, starts) == 1) @ weights[len(place) : patterns]
        return 1 / (1 + np.exp(-np.clip((total - model["cut"]) * model["slope"], -30, 30)))

    return scores


def score(docs: DataFrame, model: dict, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, ``score`` between 0 and 1, and ``predicted``."""
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        scores = scorer(shared.value)
        for batch in steps(batches, "text"):
            p = scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["id", "score", "predicted"]
            )

    narrow = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_column)


def trained(
    docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS,
    id_column: str = "doc_id", text: str = "text", label: str = "toxic",
) -> dict:
    """Model learned from the rows that are not held out."""
    known = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).where(~is_held_out("id"))
    marks = labels.select(F.col(id_column).alias("id"), F.col(label).alias("toxic")).where(~is_held_out("id"))
    return train(known, marks, toxic_rows, clean_rows)


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, ``held_out, score, predicted`` of every document."""
    found = score(docs, trained(docs, labels, id_column=id_column, text=text), id_column, text)
    return found.withColumn("held_out", is_held_out(id_column))


def without_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    model = trained(docs, labels, id_column=id_column, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scores = scorer(shared.value)
        for batch in steps(batches, text):
            yield batch.filter(pa.array(scores(batch.column(text)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
