"""Scores of texts under a context-tree model of the corpus, learned and applied without a table that all tasks hold.

Texts are lower-cased (A-Z) and taken as bytes, with one byte that no text holds before the first and after the last. The model is
that of :mod:`songloom.llm.context_trees`; its counts come from the training texts.

1. Texts are cut in chunks, stored with the chunk's different codes (a context and the byte after it) and words, and how often the
   training texts hold them. A code or word that only other texts hold counts zero and is carried along, so every question that
   will be asked has a place in the model.
2. Per bucket of keys the chunks' counts are added up.
3. Trees are weighed from the longest contexts down. A task takes all contexts that share their last bytes (``SHARED``) and weighs
   their levels; what is left are sums over one byte less, then one less again. The way back hands down what is still to be mixed.
4. Per bucket the answers go back to the chunks that asked, and each chunk scores its texts with its own answers.

Nothing grows in one place: a chunk and a bucket have a bounded number of keys, texts pass in steps, and only three sums reach the
driver. A key that every chunk holds is asked for once per chunk.

Defined cases: a null text counts as empty and has the end alone; a null id counts as an empty text when rows are dealt to
training; rows with the same id or text count and are scored each; without training rows all estimates are even; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.llm import context_trees as trees
from songloom.llm.common import hashes_of, mixed, rows_per_batch, steps, words_of
from songloom.session import stored

#: Bytes of context.
DEPTH = 5
#: Bytes of context that all contexts weighed together share.
SHARED = 3
#: Bytes of text per chunk.
CHUNK_BYTES = 32 << 20
#: Keys asked for per bucket, and the least number of buckets.
BUCKET_KEYS = 1 << 21
LEAST_BUCKETS = 32
#: Codes weighed at once in a task, as far as whole groups allow.
GROUP_ROWS = 1 << 16
#: Bytes of text whose codes are made and looked up at once.
PIECE_BYTES = 1 << 18
#: Keys that wait at least before they are added to those counted.
WAITING_KEYS = 1 << 18
#: Texts, and blobs, per Arrow batch.
BATCH_TEXTS = 1000
BATCH_BLOBS = 8
#: A byte that UTF-8 never has: what comes before a text, and its end.
EDGE = b"\xff"


def is_other(doc_id: str, fold: int = 7, other: int = 2) -> Column:
    """Rows that training leaves out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % fold == other


# Blobs: a table of a few columns in one binary value.


def packed(**columns) -> bytes:
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def _given_back() -> None:
    """Arrow keeps what is freed for later; tasks share an executor's memory, so between steps it goes back."""
    pa.default_memory_pool().release_unused()


# Codes of texts.


def codes_of(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of all bytes and ends, text after text, with the number of each text; long texts in pieces."""
    size = PIECE_BYTES
    held, numbers, total = [], [], 0
    for i, text in enumerate(texts):
        whole = text + EDGE
        for begin in range(0, len(whole), size):
            before = whole[max(0, begin - depth) : begin]
            held.append(EDGE * (depth - len(before)) + before + whole[begin : begin + size])
            numbers.append(i)
            total += len(held[-1])
            if total >= size:
                yield _codes(held, numbers, depth)
                held, numbers, total = [], [], 0
    if held:
        yield _codes(held, numbers, depth)


def _codes(pieces: list[bytes], numbers: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
    lengths = np.array([len(p) for p in pieces])
    code = flat[depth:].copy()
    for back in range(1, depth + 1):
        code |= flat[depth - back : len(flat) - back] << (8 * (depth - back + 1))
    # The first bytes of a piece are context alone.
    starts = np.cumsum(lengths) - lengths
    wanted = np.ones(len(flat), bool)
    for back in range(depth):
        wanted[starts + back] = False
    return code[wanted[depth:]], np.repeat(np.array(numbers), lengths - depth)


class Counts:
    """Different keys with the number of times training texts hold them."""

    def __init__(self, kind: pa.DataType):
        self.parts, self.waiting = [pa.table({"key": pa.array([], kind), "n": pa.array([], pa.int64())})], 0

    def add(self, more: pa.Table) -> None:
        """Keys wait until they are half as many as those counted, so memory and work stay in proportion to the different keys."""
        self.parts.append(more)
        self.waiting += len(more)
        if self.waiting > max(WAITING_KEYS, len(self.parts[0]) // 2):
            self.summed()

    def summed(self) -> pa.Table:
        """All keys once; numbers in order."""
        if self.waiting:
            table = pa.concat_tables(self.parts)
            self.parts, self.waiting = [], 0
            self.parts = [_summed(table)]
            del table
            _given_back()
        return self.parts[0]


def _summed(table: pa.Table) -> pa.Table:
    if not pa.types.is_integer(table["key"].type):
        out = table.group_by("key", use_threads=False).aggregate([("n", "sum")])
        return pa.table({"key": out["key"].combine_chunks(), "n": out["n_sum"].combine_chunks()})
    keys = table["key"].to_numpy()
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return pa.table({"key": keys[starts], "n": np.add.reduceat(table["n"].to_numpy()[order], starts)})


def _different(codes: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.unique(codes[training], return_counts=True)
    rest = np.setdiff1d(codes[~training], keys)
    return np.concatenate([keys, rest]), np.concatenate([n, np.zeros(len(rest), np.int64)])


def _chunks(depth: int, chunk_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        number, size = TaskContext.get().partitionId() << 32, 0
        codes, words = Counts(pa.int64()), Counts(pa.string())

        def row(docs=None, keys=None, kind=None, n=0):
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([docs], pa.binary()), pa.array([kind], pa.int32()), pa.array([keys], pa.binary()),
                 pa.array([n], pa.int64())],
                ["chunk", "docs", "kind", "keys", "n"],
            )

        def keys():
            for kind, counts in enumerate((codes, words)):
                table = counts.summed()
                if len(table):
                    table = table.sort_by("key").combine_chunks() if kind else table
                    yield row(kind=kind, keys=packed(key=table["key"].chunk(0), n=table["n"].chunk(0)), n=len(table))

        for batch in steps(batches, "text"):
            whole = batch.column("text").take(pa.array(np.arange(len(batch))))  # a slice would keep the offsets of all rows
            texts = pc.ascii_lower(pc.fill_null(whole, "").cast(pa.large_string()))
            training = ~batch.column("other").to_numpy(zero_copy_only=False)
            for code, text in codes_of(texts.cast(pa.large_binary()).to_pylist(), depth):
                found, n = _different(code, training[text])
                codes.add(pa.table({"key": found, "n": n}))
            flat, starts = words_of(texts)
            coded = flat.dictionary_encode()
            held = np.bincount(
                coded.indices.to_numpy(zero_copy_only=False), weights=np.repeat(training, np.diff(starts)), minlength=len(coded.dictionary)
            )
            words.add(pa.table({"key": coded.dictionary.cast(pa.string()), "n": held.astype(np.int64)}))
            yield row(docs=packed(id=batch.column("id"), other=batch.column("other"), text=texts), n=int(training.sum()))
            size += texts.nbytes
            del whole, texts, flat, coded
            _given_back()
            if size >= chunk_bytes:
                yield from keys()
                number, size, codes, words = number + 1, 0, Counts(pa.int64()), Counts(pa.string())
        yield from keys()
        codes = words = None
        _given_back()

    return run


def _bucket_of(keys: pa.Array, kind: int, buckets: int) -> np.ndarray:
    """Buckets of codes come first, then those of words."""
    hashes = hashes_of(keys) if kind else mixed(keys.to_numpy().astype(np.uint64))
    return (hashes % np.uint64(buckets)).astype(np.int64) + kind * buckets


def _dealt(table: pa.Table, kind: int, buckets: int) -> Iterator[tuple[int, pa.Table]]:
    bucket = _bucket_of(table["key"].combine_chunks(), kind, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist() if len(bucket) else []
    table = table.take(pa.array(order)).combine_chunks()
    for begin, end in zip(cuts, [*cuts[1:], len(bucket)]):
        yield int(bucket[begin]), table.slice(begin, end - begin)


def _asked(chunks: DataFrame, buckets: int) -> DataFrame:
    """What chunks ask each bucket: ``bucket, first, chunk, blob``."""

    def run(batches):
        for batch in batches:
            for chunk, kind, keys in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "keys"))):
                for bucket, part in _dealt(unpacked(keys), kind, buckets):
                    blob = packed(key=part["key"].combine_chunks(), n=part["n"].combine_chunks())
                    yield _row(bucket=bucket, chunk=chunk, blob=blob, first=False)

    return chunks.where("keys is not null").select("chunk", "kind", "keys").mapInArrow(run, "bucket long, chunk long, blob binary, first boolean")


def _row(**values) -> pa.RecordBatch:
    kinds = {"bucket": pa.int64(), "chunk": pa.int64(), "blob": pa.binary(), "first": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for k, v in values.items()], list(values))


def _by_bucket(batches, key: str, columns: list[str]):
    """``(key, iterator of rows)`` for each run of equal keys."""
    from itertools import groupby

    rows = (tuple(batch.column(c)[i].as_py() for c in columns) for batch in batches for i in range(batch.num_rows))
    at = columns.index(key)
    return groupby(rows, key=lambda r: r[at])


def _totals(buckets: int):
    """Per bucket the sums over chunks: codes as rows, words as a blob that answers later."""

    def run(batches):
        names = ["bucket", "blob", "known", "total", "gram", "n"]
        for bucket, rows in _by_bucket(batches, "bucket", ["bucket", "blob"]):
            counts = Counts(pa.string() if bucket >= buckets else pa.int64())
            for _, blob in rows:
                counts.add(unpacked(blob))
            table = counts.summed()
            n = table["n"].combine_chunks()
            if bucket >= buckets:
                known, total = int((n.to_numpy() > 0).sum()), int(n.to_numpy().sum())
                blob = packed(key=table["key"].combine_chunks(), value=n.cast(pa.float64()))
                arrays = [[bucket], [blob], [known], [total], [None], [None]]
            else:
                size = len(table)
                arrays = [pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary()), *[pa.nulls(size, pa.int64())] * 2, table["key"].combine_chunks(), n]
            kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, k) for a, k in zip(arrays, kinds)], names)
            del counts, table, n, arrays
            _given_back()

    return run


# The trees.


def _whole_groups(batches, key: str) -> Iterator[pa.Table]:
    """Rows of whole groups of a sorted stream, about ``GROUP_ROWS`` at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= GROUP_ROWS:
            table = pa.Table.from_batches(held)
            cut = int(np.searchsorted(table[key].to_numpy(), table[key][rows - 1].as_py(), side="left"))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).combine_chunks().to_batches()
                rows -= cut
    if held:
        yield pa.Table.from_batches(held)


_NODES = "context long, node int, n0 long, n1 long, weighted double"


def _lower(depth: int, shared: int):
    """Level ``shared`` of the trees, out of the codes below it."""

    def run(batches):
        for table in _whole_groups(batches, "context"):
            levels = trees.lifted(table["gram"].to_numpy(), table["n"].to_numpy(), depth, shared)
            context, node, n0, n1, weighted = trees.rows_of(levels[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(context), pa.array(node.astype(np.int32)), pa.array(n0), pa.array(n1), pa.array(weighted)],
                ["context", "node", "n0", "n1", "weighted"],
            )

    return run


def _weigh(batches):
    """Weighted probability, share and chance of a one for nodes whose longer contexts are summed in ``longer``."""
    for batch in batches:
        n0, n1 = (batch.column(c).to_numpy() for c in ("n0", "n1"))
        estimate = trees.log_estimate(n0, n1)
        if "longer" in batch.schema.names:
            weighted = trees.log_weighted(estimate, batch.column("longer").to_numpy())
        else:
            weighted = batch.column("weighted").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("context", "node", "n0", "n1")), pa.array(weighted), pa.array(trees.share(estimate, weighted)),
             pa.array((n1 + 0.5) / (n0 + n1 + 1.0))],
            ["context", "node", "n0", "n1", "weighted", "part", "own"],
        )


def _handed_down(lowest: DataFrame, shared: int) -> DataFrame:
    """For the nodes of level ``shared`` what is still to be mixed (``going``) and the chance mixed so far (``said``)."""
    levels = [lowest]
    for _ in range(shared):
        shorter = levels[-1].groupBy(F.shiftright("context", 8).alias("context"), "node").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("longer")
        )
        levels.append(stored(shorter.mapInArrow(_weigh, _NODES + ", part double, own double"), "level"))
    above = None
    for level in reversed(levels):
        if above is None:
            here = level.withColumns({"going": F.lit(1.0), "said": F.lit(0.0)})
        else:
            here = level.withColumn("above", F.shiftright("context", 8)).join(above, ["above", "node"])
        if level is lowest:
            return here.select("context", "node", "going", "said")
        above = here.select(
            F.col("context").alias("above"), "node", (F.col("going") * (1 - F.col("part"))).alias("going"),
            (F.col("said") + F.col("going") * F.col("part") * F.col("own")).alias("said"),
        )


def _answers(depth: int, shared: int, buckets: int):
    """Probabilities of the codes, as blobs for their buckets."""

    def run(batches):
        for table in _whole_groups(batches, "context"):
            is_code = table["n"].is_valid().to_numpy()
            codes = table.filter(pa.array(is_code))
            nodes = table.filter(pa.array(~is_code))
            levels = trees.lifted(codes["key"].to_numpy(), codes["n"].to_numpy(), depth, shared)
            place = nodes["context"].to_numpy() << 8 | nodes["key"].to_numpy()
            going, said = [], []
            for bit, key in enumerate(levels[-1].keys):
                at = np.searchsorted(place, key >> bit << 8 | 1 << bit | key & ((1 << bit) - 1))
                going.append(nodes["going"].to_numpy()[at])
                said.append(nodes["said"].to_numpy()[at])
            value = trees.log_chances(levels, going, said) / math.log(10)
            for bucket, part in _dealt(pa.table({"key": codes["key"], "value": value}), 0, buckets):
                blob = packed(key=part["key"].combine_chunks(), value=part["value"].combine_chunks())
                yield _row(bucket=bucket, chunk=None, blob=blob, first=True)

    return run


def _answered(batches):
    """Each chunk's keys with their values: ``chunk, docs, first, blob``."""
    for _, rows in _by_bucket(batches, "bucket", ["bucket", "chunk", "blob", "first"]):
        known, values = [], None
        for _, chunk, blob, first in rows:
            if first:
                known.append(unpacked(blob))
                continue
            if values is None:
                held = pa.concat_tables(known)
                known.clear()  # one copy at a time
                keys, values = held["key"].combine_chunks(), held["value"].combine_chunks()
                del held
            asked = unpacked(blob)["key"].combine_chunks()
            yield _row(chunk=chunk, blob=packed(key=asked, value=values.take(pc.index_in(asked, value_set=keys))), first=True)
            del asked
        keys = values = None
        _given_back()


# Scores.


def _scored(depth: int, train_tokens: int, words: int, ends: int):
    def run(batches):
        logs = lambda c: np.log10((c + 1.0) / (train_tokens + words + 1.0))
        for _, rows in _by_bucket(batches, "chunk", ["chunk", "blob", "first"]):
            answers: dict[bool, list[pa.Table]] = {False: [], True: []}
            tables = None
            for _, blob, first in rows:
                if first:
                    table = unpacked(blob)
                    answers[pa.types.is_integer(table["key"].type)].append(table)
                    continue
                if tables is None:
                    tables, table = {}, None  # one copy at a time
                    for k in [k for k, v in answers.items() if v]:
                        held = pa.concat_tables(answers.pop(k))
                        tables[k] = (held.sort_by("key") if k else held).combine_chunks()
                        del held
                yield _scores(unpacked(blob).combine_chunks(), tables, logs)
                _given_back()

    def _scores(docs: pa.Table, tables: dict, logs) -> pa.RecordBatch:
        texts = docs["text"].combine_chunks()
        score = np.zeros(len(docs))
        keys, values = (tables[True][c].to_numpy() for c in ("key", "value"))
        for code, text in codes_of(texts.cast(pa.large_binary()).to_pylist(), depth):
            different, place = np.unique(code, return_inverse=True)
            score += np.bincount(text, weights=values[np.searchsorted(keys, different)][place], minlength=len(docs))
        flat, starts = words_of(texts)
        count = np.zeros(0)
        if len(flat):
            at = pc.index_in(flat.cast(pa.string()), value_set=tables[False]["key"].combine_chunks()).to_numpy()
            count = tables[False]["value"].to_numpy()[at]
        of = np.repeat(np.arange(len(docs)), np.diff(starts))
        base = np.bincount(of, weights=logs(count), minlength=len(docs)) + logs(float(ends))
        known = np.bincount(of, weights=count > 0, minlength=len(docs)).astype(np.int64) + (ends > 0)
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        bits = -score / math.log10(2) / (size + 1)
        return pa.RecordBatch.from_arrays(
            [docs["id"].combine_chunks(), docs["other"].combine_chunks(), pa.array(np.diff(starts).astype(np.int64) + 1), pa.array(known),
             pa.array(np.full(len(docs), train_tokens, np.int64)), pa.array(base), pa.array(score), pa.array(bits)],
            ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
        )

    return run


def score_texts(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", depth: int = DEPTH, shared: int = SHARED, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per text: id, ``held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    ``score`` is the base-10 logarithm of the model's probability of the text and its end, ``bits_per_byte`` the code length; the base
    is a model of single words with one added to every count.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), is_other(id_column).alias("other"))
    id_type = rows.schema["id"].dataType.simpleString()
    cut = rows.mapInArrow(_chunks(depth, chunk_bytes), "chunk long, docs binary, kind int, keys binary, n long")
    with rows_per_batch(spark, BATCH_TEXTS):
        chunks = stored(cut, "chunks")
    sizes = chunks.agg(F.sum(F.when(F.col("keys").isNotNull(), F.col("n"))).alias("keys"), F.sum(F.when(F.col("docs").isNotNull(), F.col("n"))).alias("ends")).first()
    ends, buckets = sizes["ends"] or 0, max(LEAST_BUCKETS, (sizes["keys"] or 0) // BUCKET_KEYS)

    with rows_per_batch(spark, BATCH_BLOBS):
        asked = _asked(chunks, buckets)
        in_buckets = asked.select("bucket", "blob").repartition("bucket").sortWithinPartitions("bucket")
        summed = "bucket long, blob binary, known long, total long, gram long, n long"
        totals = stored(in_buckets.mapInArrow(_totals(buckets), summed), "totals")
    sums = totals.agg(F.sum("known").alias("known"), F.sum("total").alias("total")).first()
    words, train_tokens = (sums["known"] or 0) + (ends > 0), (sums["total"] or 0) + ends

    context = F.shiftright("gram", 8 * (depth - shared + 1)).alias("context")
    grams = totals.where("gram is not null").select(context, "gram", "n")
    lower = grams.repartition("context").sortWithinPartitions("context", "gram").mapInArrow(_lower(depth, shared), _NODES)
    lowest = stored(lower, "nodes")
    nodes = _handed_down(lowest, shared).select(
        "context", F.col("node").cast("long").alias("key"), F.lit(None).cast("long").alias("n"), "going", "said"
    )
    with_nodes = grams.select("context", F.col("gram").alias("key"), "n", F.lit(0.0).alias("going"), F.lit(0.0).alias("said")).unionByName(nodes)
    grouped = with_nodes.repartition("context").sortWithinPartitions("context", F.col("n").isNotNull(), "key")
    model = grouped.mapInArrow(_answers(depth, shared, buckets), "bucket long, chunk long, blob binary, first boolean")
    counted = totals.where("bucket is not null").select("bucket", F.lit(None).cast("long").alias("chunk"), "blob", F.lit(True).alias("first"))
    model = stored(model.unionByName(counted), "model")

    with rows_per_batch(spark, BATCH_BLOBS):
        asked = model.unionByName(_asked(chunks, buckets)).repartition("bucket").sortWithinPartitions("bucket", F.desc("first"))
        answers = asked.mapInArrow(_answered, "chunk long, blob binary, first boolean")
        texts = chunks.where("docs is not null").select("chunk", F.col("docs").alias("blob"), F.lit(False).alias("first"))
        at_chunk = stored(answers, "answers").unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", F.desc("first"))
        schema = (
            f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
            "bits_per_byte double"
        )
        scored = stored(at_chunk.mapInArrow(_scored(depth, train_tokens, words, ends), schema), "scores")
    return scored.withColumnRenamed("id", id_column)
