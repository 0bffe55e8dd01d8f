"""Removal of repeated passages by level-wise doubling.

A window of words can only repeat if its shorter windows do. So windows of few words come first: those found once
only are out, those that repeat are extended to twice the length, and so on until the asked length is reached or no
candidates are left. At the asked length the first occurrence of each window stays, and every word that a later
one covers is removed.

Texts are laid out once in chunks of about ``CHUNK_BYTES``, in a bucketed table, so they are never shuffled. At each
level a chunk sends the distinct window hashes of its candidates, packed per hash bucket; a window that a third of
all texts hold is one entry per chunk. A bucket answers with one bit per entry: whether the window occurs elsewhere
or twice in the chunk, and at the last level whether this chunk holds its first occurrence. Answers are joined to
the bucketed chunks, as hash tables beside which the texts stream unsorted, and become the candidates of the next level.

At the last level hashes have 128 bits. Before it they only decide what is looked at further: the bucket and 32
bits more, whatever the number of buckets, so that about one window in 2,000 is looked at in vain.

Words are runs of anything but ASCII white space. The order of occurrences is that of the ids, then places.

Defined cases: a null text has no words; texts shorter than a window keep all words; null ids come first; rows with
the same id are in the order of their places in chunks; the digest of no words is that of an empty text; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.llm.common import by_group, coded, hashes_of, mixed, rows_per_batch, steps, sums, words_of
from songloom.session import new_dir, stored

#: Text that a chunk holds, unless one text is longer.
CHUNK_BYTES = 4 << 20
#: Window hashes that a bucket should hold.
BUCKET_WINDOWS = 2_000_000
#: Words of the shortest windows.
FIRST = 5
#: Bits of a window hash that are sent besides the bucket, before the last level.
SENT_BITS = 32


def _chunked(docs: DataFrame, limit: int) -> DataFrame:
    """``chunk, ids, texts, windows``: texts in runs, and about how many windows they have."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def packed():
            table = pa.Table.from_batches(held)
            texts = [t or "" for t in table.column("text").to_pylist()]
            words = sum(t.count(" ") + 1 for t in texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string())), pa.array([words])],
                ["chunk", "ids", "texts", "windows"],
            )

        for batch in steps(batches, "text", limit):
            held.append(batch)
            size += batch.nbytes
            if size >= limit:
                yield packed()
                held, size, number = [], 0, number + 1
        if held:
            yield packed()

    return docs.mapInArrow(run, "chunk long, ids array<long>, texts array<string>, windows long")


class Chunk:
    """Words of a chunk's texts as hashes, and hashes of its windows."""

    def __init__(self, texts: pa.Array):
        self.words, self.starts = words_of(texts)
        codes, distinct = coded(self.words)
        self.base = hashes_of(distinct)
        self.hashes = self.base[codes]
        #: Words from each place to the end of its text.
        self.left = np.repeat(self.starts[1:], np.diff(self.starts)) - np.arange(len(codes))

    def windows(self, length: int, seed: int = 1) -> np.ndarray:
        """Hash of the window that starts at each place; by doubling, from windows of half the length."""
        if length == 1:
            return mixed(self.hashes * np.uint64(2 * seed + 1))
        half = length // 2
        short = self.windows(half, seed)
        value = short * np.uint64(0x9E3779B97F4A7C15)
        value[:-half] += mixed(short[half:])
        if length % 2:
            value = mixed(value)
            value[: -(length - 1)] += self.hashes[length - 1 :]
        return mixed(value + np.uint64(length))


def _holds(candidates: np.ndarray, short: int, length: int) -> np.ndarray:
    """Places whose window of ``length`` has candidates at all its parts of ``short`` words."""
    held = candidates.copy()
    for shift in sorted({*range(short, length - short + 1, short), length - short}):
        ahead = np.zeros(len(held), bool)
        ahead[: max(0, len(held) - shift)] = candidates[shift:]
        held &= ahead
    return held


def _distinct(chunk: Chunk, ids: np.ndarray, places: np.ndarray, length: int, last: bool, bits: int):
    """Distinct windows of the candidates: keys, and which place comes first by id and place, and which repeat here.

    Before the last level a key is the first ``bits + SENT_BITS`` bits of the hash.
    """
    key = chunk.windows(length)[places]
    if not last:
        key = key >> np.uint64(max(0, 64 - SENT_BITS - bits))
    if last:
        other = chunk.windows(length, 7)[places]
        row = np.searchsorted(chunk.starts, places, side="right") - 1
        order = np.lexsort((places, row, ids[row], other, key))
        key, other = key[order], other[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (other[1:] != other[:-1])
    else:
        other = None
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
    return key, other, order, new


#: A null id, as a number below all ids.
_NONE = np.iinfo(np.int64).min


def _ids_of(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return np.array([_NONE if x is None else x for x in batch.column("ids")[i].as_py()], np.int64)


def _sent(chunk: Chunk, number: int, ids: np.ndarray, places: np.ndarray, length: int, last: bool, bits: int):
    """Columns ``bucket, chunk, keys, more`` of one chunk's windows at ``places``."""
    rows: dict[str, list] = {"bucket": [], "chunk": [], "keys": [], "more": []}
    if not len(places):
        return rows
    key, other, order, new = _distinct(chunk, ids, places, length, last, bits)
    first = np.flatnonzero(new)
    repeats = np.diff(np.append(first, len(key))) > 1
    width = 64 if last else SENT_BITS + bits
    bucket = (key[first] >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(first), np.int64)
    form = "<u8" if last else "<u4"
    ends = np.searchsorted(bucket, np.arange(1 << bits), side="right")
    row = np.searchsorted(chunk.starts, places[order[first]], side="right") - 1
    begin = 0
    for b, end in enumerate(ends.tolist()):
        if end > begin:
            rows["bucket"].append(b)
            rows["chunk"].append(number)
            rows["keys"].append(key[first[begin:end]].astype(form).tobytes())
            if last:
                rows["more"].append(other[first[begin:end]].astype("<u8").tobytes() + ids[row[begin:end]].astype("<i8").tobytes())
            else:
                rows["more"].append(np.packbits(repeats[begin:end]).tobytes())
        begin = end
    return rows


def _answer(last: bool):
    """For all entries of a bucket, one bit each: seen more than once, or at the last level, holding the first occurrence."""

    def run(table: pa.Table):
        chunks = table.column("chunk").to_numpy()
        if table.column("bucket")[0].as_py() < 0:  # a chunk's own candidates go through
            n = pa.array([int.from_bytes(m, "big") for m in table.column("more").to_pylist()], pa.int64())
            own = [pa.array(chunks), table.column("bucket").combine_chunks(), n, table.column("keys").combine_chunks()]
            return [pa.RecordBatch.from_arrays(own, ["chunk", "bucket", "n", "bits"])]
        keys = [np.frombuffer(k, "<u8" if last else "<u4") for k in table.column("keys").to_pylist()]
        more = table.column("more").to_pylist()
        sizes = np.array([len(k) for k in keys])
        key = np.concatenate(keys)
        if last:
            other = np.concatenate([np.frombuffer(m[: 8 * n], "<u8") for m, n in zip(more, sizes)])
            ids = np.concatenate([np.frombuffer(m[8 * n :], "<i8") for m, n in zip(more, sizes)])
            order = np.lexsort((np.repeat(chunks, sizes), ids, other, key))
            a, b = key[order], other[order]
            bit = np.ones(len(key), bool)
            bit[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        else:
            again = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(more, sizes)]).astype(bool)
            order = np.argsort(key, kind="stable")
            a, bit = key[order], again[order]
            same = a[1:] == a[:-1]
            bit[1:] |= same
            bit[:-1] |= same
        out = np.empty(len(key), bool)
        out[order] = bit
        ends = np.cumsum(sizes)
        packed = [np.packbits(out[e - n : e]).tobytes() for e, n in zip(ends, sizes)]
        return [
            pa.RecordBatch.from_arrays(
                [table.column("chunk").combine_chunks(), table.column("bucket").combine_chunks(), pa.array(sizes), pa.array(packed, pa.binary())],
                ["chunk", "bucket", "n", "bits"],
            )
        ]

    return run


def _bits(row: list[dict]) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]) for x in sorted(row, key=lambda x: x["bucket"])]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _unpacked(held: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(held, np.uint8), count=n).astype(bool)


def _places(chunk: Chunk, length: int, short: int, before: np.ndarray | None) -> np.ndarray:
    """Places of windows of ``length`` all of whose parts of ``short`` words are candidates."""
    places = chunk.left >= length
    if before is not None:
        places &= _holds(before, short, length)
    return np.flatnonzero(places)


def _candidates(chunk: Chunk, ids: np.ndarray, places: np.ndarray, length: int, again: np.ndarray, bits: int) -> np.ndarray:
    """Which places hold windows of ``length`` that were answered to repeat."""
    found = np.zeros(len(chunk.left), bool)
    if len(places):
        _, _, order, new = _distinct(chunk, ids, places, length, False, bits)
        found[places[order]] = again[np.cumsum(new) - 1]
    return found


def _removed(chunk: Chunk, ids: np.ndarray, places: np.ndarray, length: int, bits: np.ndarray) -> np.ndarray:
    """Words covered by a window that also starts earlier."""
    gone = np.zeros(len(chunk.left) + 1, np.int64)
    if len(places):
        _, _, order, new = _distinct(chunk, ids, places, length, True, 0)
        first = new & bits[np.cumsum(new) - 1]
        at = places[order[~first]]
        np.add.at(gone, at, 1)
        np.add.at(gone, at + length, -1)
    return np.cumsum(gone[:-1]) > 0


class Doubling:
    """The levels over one table of texts."""

    def __init__(self, docs: DataFrame, length: int, first: int, chunk_bytes: int, bucket_windows: int):
        self.spark = docs.sparkSession
        self.levels = [length]
        while self.levels[0] % 2 == 0 and self.levels[0] // 2 >= first:
            self.levels.insert(0, self.levels[0] // 2)
        while self.levels[0] > 2 * first:
            self.levels.insert(0, (self.levels[0] + 1) // 2)
        self.name = name = f"chunks_{uuid.uuid4().hex}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with rows_per_batch(self.spark, 2000):
            laid = _chunked(docs, chunk_bytes)
            # Chunks are whole in a file of their own, so bucketing them needs no shuffle.
            laid.write.bucketBy(parts, "chunk").option("path", new_dir(self.spark, "chunks")).saveAsTable(name)
        self.chunks = self.spark.table(name)
        total = self.chunks.agg(F.sum("windows")).first()[0] or 0
        self.bits = max(0, (total // bucket_windows).bit_length())

    def _before(self, known: DataFrame | None, answers: DataFrame | None) -> DataFrame:
        """Chunks with the candidates they had before the last answers, and these answers."""
        source = self.chunks.drop("windows")
        if answers is not None:
            source = source.join(answers.hint("shuffle_hash"), "chunk", "left")
        if known is not None:
            source = source.join(known.hint("shuffle_hash"), "chunk", "left")
        return source

    def ask(self, level: int, known: DataFrame | None, answers: DataFrame | None):
        """One level: candidates from the answers of the level before, their windows sent, and the answers to those.

        Gives ``known`` (``chunk, held, n``: candidates of the level before) and ``answers`` by chunk, or None for
        answers where no candidates are left.
        """
        levels, bits = self.levels, self.bits
        last = level == len(levels) - 1

        def send(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    number = batch.column("chunk")[i].as_py()
                    found, short = None, 0
                    if level:
                        replies = batch.column("answers")[i].as_py()
                        if not replies:
                            continue
                    chunk, ids = Chunk(batch.column("texts")[i].values), _ids_of(batch, i)
                    if level:
                        short = levels[level - 1]
                        before = None
                        if level > 1:
                            before = _unpacked(batch.column("held")[i].as_py(), batch.column("n")[i].as_py())
                        asked = _places(chunk, short, levels[level - 2] if level > 1 else 0, before)
                        found = _candidates(chunk, ids, asked, short, _bits(replies), bits)
                    rows = _sent(chunk, number, ids, _places(chunk, levels[level], short, found), levels[level], last, bits)
                    if level:  # the candidates themselves are kept beside the windows
                        rows["bucket"].append(-1 - number)
                        rows["chunk"].append(number)
                        rows["keys"].append(np.packbits(found).tobytes())
                        rows["more"].append(len(found).to_bytes(8, "big"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows["bucket"], pa.int64()), pa.array(rows["chunk"], pa.int64()), pa.array(rows["keys"], pa.binary()), pa.array(rows["more"], pa.binary())],
                        ["bucket", "chunk", "keys", "more"],
                    )

        # Windows are written once, by the shuffle; one row of a chunk or of a bucket at a time is in the tasks' hands.
        with rows_per_batch(self.spark, 1):
            sent = self._before(known, answers).mapInArrow(send, "bucket long, chunk long, keys binary, more binary")
            answered = stored(by_group(sent, ["bucket"], _answer(last), "chunk long, bucket long, n long, bits binary"), "answers")
        kept = answered.where("bucket < 0").select("chunk", F.col("bits").alias("held"), "n") if level else None
        replies = answered.where("bucket >= 0")
        if replies.isEmpty():
            return kept, None
        return kept, replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("answers"))


def remove_repeats(
    docs: DataFrame, length: int = 20, first: int = FIRST, keep_text: bool = False, id_column: str = "doc_id",
    text: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_windows: int = BUCKET_WINDOWS,
) -> DataFrame:
    """Id, ``n_words, n_removed, kept_sha256`` per document, and with ``keep_text`` the ``kept_text`` itself."""
    kind = docs.schema[id_column].dataType
    work = Doubling(docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")), length, first, chunk_bytes, bucket_windows)
    known = answers = None
    for level in range(len(work.levels)):
        known, answers = work.ask(level, known, answers)
        if answers is None:
            break
    short = work.levels[-2] if len(work.levels) > 1 else 0

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk(batch.column("texts")[i].values)
                gone = np.zeros(len(chunk.left), bool)
                replies = batch.column("answers")[i].as_py()
                if replies:
                    held = _unpacked(batch.column("held")[i].as_py(), batch.column("n")[i].as_py()) if short else None
                    gone = _removed(chunk, _ids_of(batch, i), _places(chunk, length, short, held), length, _bits(replies))
                words = chunk.words.filter(pa.array(~gone)).cast(pa.binary()).to_pylist()
                ends = np.concatenate(([0], np.cumsum(~gone)))[chunk.starts]
                kept = [b" ".join(words[a:b]) for a, b in zip(ends, ends[1:])]
                columns = [
                    batch.column("ids")[i].values, pa.array(np.diff(chunk.starts)), pa.array(sums(gone.astype(np.int64), chunk.starts)),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                ]
                names = ["id", "n_words", "n_removed", "kept_sha256"]
                if keep_text:
                    columns.append(pa.array([k.decode() for k in kept]))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names)

    source = work._before(known if answers is not None else None, answers)
    if answers is None:
        source = source.withColumn("answers", F.lit(None).cast("array<struct<bucket:long,n:long,bits:binary>>"))
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    with rows_per_batch(work.spark, 1):
        done = stored(source.mapInArrow(run, schema), "kept")
    work.spark.sql(f"DROP TABLE IF EXISTS {work.name}")  # the files stay in the shared folder
    return done.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_column)
