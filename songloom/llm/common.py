"""What the operators share: words as Arrow arrays, batches balanced by bytes, groups of a sorted stream, splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step inside a task works on.
STEP_BYTES = 4 << 20


def is_held_out(doc_id: Column | str) -> Column:
    """Every fifth row by the checksum of its id; a null id counts as an empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows, for jobs that run inside and whose rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def steps(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in order, cut so that each piece holds about ``limit`` bytes of ``text``; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs of anything but ASCII white space) in order, and where each row's words start; null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    kept = np.concatenate(([0], np.cumsum(full, dtype=np.int64)))
    return flat.filter(pa.array(full)), kept[offsets]


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Code of each word, and the distinct words by code."""
    held = words.dictionary_encode()
    return held.indices.to_numpy(zero_copy_only=False), held.dictionary


def hashes_of(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words, from their bytes."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers, so that any bits of them may serve as a hash."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i]``, one range after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts.astype(np.int64) - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per row, rows being ``starts[i]:starts[i + 1]``; works for empty rows, along axis 0."""
    ends = np.zeros((len(values) + 1, *values.shape[1:]), values.dtype)
    np.cumsum(values, axis=0, out=ends[1:])
    return ends[starts[1:]] - ends[starts[:-1]]


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal ``keys``, of a stream in which such rows stand together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        differs = np.zeros(batch.num_rows, bool)
        for column in columns:
            values = column.to_numpy(zero_copy_only=False)
            differs[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(differs).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            part = batch.slice(begin, end - begin)
            if held and any(held[-1].column(k)[held[-1].num_rows - 1] != part.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def by_group(df: DataFrame, keys: list[str], function: Callable, schema: str, parts: int | None = None) -> DataFrame:
    """Apply ``function(table) -> list of record batches`` to all rows of each key, small groups in one stream.

    One Python stream works through many groups, which costs less than a call of its own for each of many
    small ones. Groups must be bounded by the caller.
    """

    def run(batches):
        for table in sorted_groups(batches, keys):
            yield from function(table)

    dealt = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, schema)


def all_finite(vector: Column) -> Column:
    """Not null, and no component null, infinite or not a number; an empty vector passes."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def matrix_of(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
