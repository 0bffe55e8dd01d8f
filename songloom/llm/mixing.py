"""Mixing sources to target weights by balanced sampling with the cube method.

A source of ``size`` words with target ``t`` takes each of its documents ``t / size`` times: the whole part is
taken for certain, the fraction is an inclusion probability. The cube method turns the probabilities into
decisions without changing the balance: three undecided documents at a time span a line along which the words
and the number of documents that are taken stay the same (the null space of the two balancing constraints);
probabilities move along it at random until one is decided. What cannot move any more, two documents at most, is
the landing problem, decided so that the balance is missed least.

Documents are dealt out by hash in chunks of a source. A chunk's flight leaves two documents undecided at most;
these meet in chunks again, level by level, until each source has only its own landing problem. So no task sees
more than a chunk, and the words taken miss the target by no more than the landing's share.

Sizes are counts of runs of anything but ASCII white space. Random numbers come from hashes of the chunk, and a
chunk's documents are in a fixed order, so reruns agree.

Defined cases: a null text has size 0, and so has a text of white space; documents of size 0 are taken like
others and weigh nothing; null sources are one source, the last; repeated rows share their inclusions as equally
as whole numbers allow; a source or table of size 0 has target 0 and takes nothing; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songloom.session import stored

#: Undecided documents that one task decides at a time.
CHUNK = 2048


def word_count(text: str) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill_targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """``target`` per source from ``size`` and ``weight``: parts of ``share`` of all sizes by weight, none above ``cap`` times the size.

    One row per source. Sources are filled in order of ``cap * size / weight``; those that are full hand their
    excess to the others by weight, which is one level for all that are not full.
    """
    order = Window.orderBy("_ratio", "source_rank")
    total, weight = F.sum("size").over(Window.partitionBy()), F.col("weight")
    above = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sources.withColumn("_full", F.col("size") * cap).withColumn("_ratio", F.col("_full") / weight)
    level = (total * share - F.coalesce(F.sum("_full").over(below), F.lit(0.0))) / F.sum("weight").over(above)
    ranked = ranked.withColumn("_level", level)
    fits = F.when(F.col("_ratio") >= F.col("_level"), F.col("_level"))
    open_level = F.first(fits, ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.when(F.col("size") == 0, 0.0).otherwise(
        F.least(F.col("_full"), weight * F.coalesce(open_level, F.col("_ratio")))
    )
    return ranked.withColumn("target", target.cast("double")).drop("_full", "_ratio", "_level")


def cyclic_weights(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Weights given to the sources in turn, by code points of their names, null last."""
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    given = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("source_rank", rank)
    return ranked.withColumn("weight", F.element_at(given, (F.col("source_rank") % len(weights) + 1).cast("int")))


def flight(sizes: np.ndarray, fraction: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Probabilities after the flight; all but two of them at most are 0 or 1.

    ``draws`` are numbers in [0, 1), one per step. A step keeps ``sum(p)`` and ``sum(p * sizes)``.
    """
    p = fraction.astype(float).tolist()
    s = sizes.astype(float).tolist()
    tiny = 1e-9
    held: list[int] = []
    draw = iter(draws.tolist())
    for i in range(len(p)):
        if tiny < p[i] < 1 - tiny:
            held.append(i)
        while len(held) == 3:
            a, b, c = held
            # Null space of the rows (1, 1, 1) and (s_a, s_b, s_c); with equal sizes any shift between two will do.
            u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / v if v > 0 else -p[k] / v for k, v in zip(held, u) if v)
            down = min(p[k] / v if v > 0 else (p[k] - 1) / v for k, v in zip(held, u) if v)
            step = up if next(draw) * (up + down) < down else -down
            for k, v in zip(held, u):
                moved = p[k] + step * v
                p[k] = 0.0 if moved < tiny else 1.0 if moved > 1 - tiny else moved
            held = [k for k in held if 0.0 < p[k] < 1.0]
    return np.clip(np.array(p), 0.0, 1.0)


def landing(sizes: np.ndarray, p: np.ndarray, draw: float) -> np.ndarray:
    """Decide the two open probabilities at most: of the choices that miss the words least, one at random."""
    open_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    p = np.round(np.where((p > 1e-9) & (p < 1 - 1e-9), p, np.round(p)), 12)
    if not len(open_):
        return p
    wanted = float((p[open_] * sizes[open_]).sum())
    choices = [[(c >> j) & 1 for j in range(len(open_))] for c in range(1 << len(open_))]
    miss = [abs(sum(x * sizes[k] for x, k in zip(c, open_)) - wanted) for c in choices]
    best = [c for c, m in zip(choices, miss) if m == min(miss)]
    p[open_] = best[int(draw * len(best)) % len(best)]
    return p


def _fly(last: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_order", "doc", "size"], kind="stable", na_position="first")
        seed = int(frame["_order"].iloc[0]) & 0x7FFFFFFFFFFFFFFF
        draws = np.random.Generator(np.random.PCG64(seed)).random(len(frame) + 1)
        size = frame["size"].to_numpy(float)
        p = flight(size, frame["p"].to_numpy(float), draws)
        frame["p"] = landing(size, p, draws[-1]) if last else p
        return frame

    return run


def inclusions(
    docs: DataFrame, weights: tuple[float, ...], share: float = 1.5, cap: float = 2.0, chunk: int = CHUNK,
    id_column: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """Per distinct (id as text, source, size): number of such ``rows``, times ``total`` they are taken, the source's figures."""
    measured = docs.select(
        F.col(id_column).cast("string").alias("doc"), F.col(source).cast("string").alias("source"),
        word_count(text).alias("size"),
    )
    units = stored(measured.groupBy("doc", "source", "size").agg(F.count("*").alias("rows")), "sizes")
    per_source = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("size"), F.count("*").alias("units")
    )
    # One row per source from here on.
    targets = stored(fill_targets(cyclic_weights(per_source, weights), share, cap), "targets")
    known = targets.select(
        F.struct("source").alias("_source"), F.col("size").alias("source_size"), "target", "source_rank",
        F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0).alias("rate"),
        F.greatest(F.lit(1), F.ceil(F.col("units") / chunk)).cast("long").alias("chunks"),
    )
    rated = units.withColumn("_source", F.struct("source")).join(known, "_source").drop("_source")
    wanted = F.col("rate") * F.col("rows")
    whole = F.floor(wanted + 1e-9)
    pending = rated.select(
        "*", whole.alias("whole"), F.greatest(F.lit(0.0), wanted - whole).alias("p"),
        F.xxhash64("source", "doc", "size").alias("_order"),
    ).withColumn("chunk", F.pmod(F.col("_order"), F.col("chunks")))
    most = targets.agg(F.max("units")).first()[0] or 0
    columns = pending.columns
    decided = []
    groups = math.ceil(most / chunk)
    undecided = (F.col("p") > 1e-9) & (F.col("p") < 1 - 1e-9)
    while True:
        last = groups <= 1
        flown = pending.groupBy("source_rank", "chunk").applyInPandas(_fly(last), pending.schema)
        if last:
            decided.append(flown)
            break
        flown = stored(flown, "flight")
        decided.append(flown.where(~undecided))
        # Two undecided documents at most come out of each chunk.
        pending = flown.where(undecided).withColumn("chunk", F.floor(F.col("chunk") / (chunk // 2)))
        groups = math.ceil(groups / (chunk // 2))
    out = decided[0].select(columns)
    for more in decided[1:]:
        out = out.unionByName(more.select(columns))
    return out.select(
        "doc", "source", "size", "rows", "source_size", "target", (F.col("whole") + F.round("p")).cast("long").alias("total")
    )


def taken_words(
    docs: DataFrame, weights: tuple[float, ...], share: float = 1.5, cap: float = 2.0,
    id_column: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """One row per document: id, ``size, source_size, target, taken`` in words, and the number of ``copies``."""
    found = inclusions(docs, weights, share, cap, id_column=id_column, text=text, source=source)
    each = found.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copies = F.floor(F.col("total") / F.col("rows")) + (F.col("_nth") <= F.col("total") % F.col("rows")).cast("long")
    return each.select(
        F.col("doc").cast(docs.schema[id_column].dataType).alias(id_column), "size", "source_size", "target", (copies * F.col("size")).alias("taken"),
        copies.alias("copies"), F.col("source"),
    )


def mixed_documents(
    docs: DataFrame, weights: tuple[float, ...], share: float = 1.5, cap: float = 2.0,
    id_column: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The mixture with all columns of the documents: each as often as it is taken."""
    found = stored(inclusions(docs, weights, share, cap, id_column=id_column, text=text, source=source), "inclusions")
    key = F.struct(F.col(id_column).cast("string").alias("doc"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"))
    wanted = found.where(F.col("total") > 0).select(F.struct("doc", "source", "size").alias("_key"), "rows", "total")
    # The documents' columns go as one, so that none of their names can meet one of ours.
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), key.alias("_key")).join(wanted, "_key")
    alone = keyed.where(F.col("rows") == 1).withColumn("_copies", F.col("total"))
    if not wanted.where(F.col("rows") > 1).isEmpty():
        nth = F.row_number().over(Window.partitionBy("_key").orderBy(F.col("_doc")[text]))
        share_of = F.floor(F.col("total") / F.col("rows")) + (nth <= F.col("total") % F.col("rows")).cast("long")
        alone = alone.unionByName(keyed.where(F.col("rows") > 1).withColumn("_copies", share_of))
    repeated = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    return alone.where(F.col("_copies") > 0).select("_doc", repeated).select("_doc.*")
