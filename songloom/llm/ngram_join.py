"""N-gram Jaccard join by MinHash banding, with every found pair verified on the full n-gram sets.

A text is the set of hashes of its runs of five words; a text of fewer words is one run of all of them. Texts with
the same set are one class with a weight, so copies never meet each other. Band and row counts follow from the
recall asked for at the threshold. Classes are shuffled by band hash; in each bucket the smallest class leads, and
every class keeps the few different leaders of its buckets, so sets are sent once per leader, not once per band.

The members of a leader are compared on their full sets inside tasks, in blocks of a fixed size against each
other where there are many, so a group of any size is spread over tasks and no pair is left out. A pair that
shares several leaders counts at the smallest. Tasks give back link counts and the links of a spanning forest,
never all pairs; components come from those.

Words are runs of anything but ASCII white space, as they are written.

Defined cases: texts that are null or have no word link with nothing, copies of them neither; rows with the same id and
text count as two; a null id links like any other and is the smallest of its group only if all are null; other
columns are ignored by ``near_groups`` and kept by ``without_near_copies``; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.llm.common import by_group, coded, hashes_of, mixed, rows_per_batch, steps, words_of
from songloom.llm.components import components
from songloom.operators.equijoin import splittable_join
from songloom.session import stored

WORDS = 5
#: Members of a leader that one task compares with as many others.
BLOCK = 256
#: Hashes that are worked on at a time, so that they stay in the processor's cache.
CACHED = 1 << 15


def banding(threshold: float, recall: float, most: int = 160) -> tuple[int, int]:
    """Bands and rows per band: the most selective ones within ``most`` hashes whose recall at the threshold is reached."""
    best, rows = (1, 1), 1
    while rows <= most and threshold**rows > 1e-9:
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
        rows += 1
    return best


def gram_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word runs of each text."""
    flat, starts = words_of(texts)
    codes, distinct = coded(flat)
    values = hashes_of(distinct)[codes]
    found = []
    for begin, end in zip(starts.tolist(), starts[1:].tolist()):
        n = end - begin
        if not n:
            found.append(np.zeros(0, np.uint64))
            continue
        width = min(words, n)
        value = np.full(n - width + 1, width, np.uint64)
        for k in range(width):
            value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + values[begin + k : end - width + 1 + k])
        found.append(np.unique(value))
    return found


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes per set; sets must not be empty."""
    rng = np.random.default_rng(20240229)
    factor = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    least = np.empty((bands * rows, len(sets)), np.uint64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= CACHED):
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.cumsum([0] + [len(s) for s in sets[at : end - 1]])
        work = np.empty_like(flat)
        for k in range(bands * rows):
            np.multiply(flat, factor[k], out=work)
            np.add(work, shift[k], out=work)
            least[k, at:end] = np.minimum.reduceat(work, starts)
        at = end
    value = np.zeros((bands, len(sets)), np.uint64)
    for r in range(rows):
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + least.reshape(bands, rows, -1)[:, r])
    return value.T


def _signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``id, digest, bands``: a digest of the whole set, null for texts without words."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        import hashlib

        for batch in steps(batches, "text"):
            sets = gram_sets(batch.column("text"))
            full = [i for i, s in enumerate(sets) if len(s)]
            digests: list = [None] * len(sets)
            for i in full:
                digests[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
            keys: list = [None] * len(sets)
            if full:
                for i, row in zip(full, band_hashes([sets[i] for i in full], bands, rows).view(np.int64)):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "digest", "bands"]
            )

    return docs.mapInArrow(run, f"id {kind}, digest binary, bands array<long>")


#: Bits of the filter that tells which documents' sets may be wanted: a fixed 2 MB, whatever the data.
FILTER_BITS = 1 << 24


def _filter_bit(column: str):
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def _filter_of(wanted: DataFrame) -> bytes:
    """Bit set of the hashed ids. A full filter lets through more texts; which sets are used is decided by digests."""
    bit = wanted.select(_filter_bit("id").alias("bit"))
    words = bit.groupBy(F.floor(F.col("bit") / 32768).alias("word")).agg(F.bitmap_construct_agg((F.col("bit") % 32768).cast("long")).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for row in words.collect():  # 512 rows of 4 KB at most
        out[row["word"] * 4096 : row["word"] * 4096 + len(row["bits"])] = row["bits"]
    return bytes(out)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rep, grams`` (digest and set as bytes), once per class, of the documents whose ids may be wanted.

    Texts are filtered where they are read, so only the sets that are needed are shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted))

    def run(batches):
        import hashlib

        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            part = batch.filter(pa.array(bits[batch.column("bit").to_numpy()]))
            for step in steps(iter([part]), "text"):
                grams = [s.astype("<u8").tobytes() for s in gram_sets(step.column("text"))]
                reps = [hashlib.blake2b(g, digest_size=16).digest() for g in grams]
                yield pa.RecordBatch.from_arrays([pa.array(reps, pa.binary()), pa.array(grams, pa.binary())], ["rep", "grams"])

    made = docs.select("text", _filter_bit("id").alias("bit")).mapInArrow(run, "rep binary, grams binary")
    return made.dropDuplicates(["rep"])


def compare_block(table: pa.Table, threshold: float) -> list[pa.RecordBatch]:
    """Links between the members of two blocks of a leader (or within one), counted by weights."""
    leader = table.column("leader")[0].as_py()
    inner = table.column("p")[0].as_py() == table.column("q")[0].as_py()
    reps = table.column("rep").to_pylist()
    side = table.column("block").to_numpy() == table.column("p")[0].as_py()
    weight = table.column("weight").to_numpy()
    leaders = table.column("leaders").to_pylist()
    sets = [np.frombuffer(g, "<u8") for g in table.column("grams").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, side, weight = sizes[order], side[order], weight[order]
    sets, leaders, reps = [sets[i] for i in order], [leaders[i] for i in order], [reps[i] for i in order]
    flat = np.concatenate(sets)
    _, codes = np.unique(flat, return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    mark = np.zeros(int(codes.max()) + 1, np.int32)
    several = [x if len(x) > 1 else None for x in leaders]
    links = np.zeros(len(sets), np.int64)
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(sets) - 1):
        # Sets in order of size: those after i that can still be similar enough.
        end = int(np.searchsorted(sizes, sizes[i] / threshold + 1e-9, side="right"))
        if end <= i + 1:
            continue
        mine = codes[starts[i] : starts[i + 1]]
        mark[mine] = 1
        shared = np.add.reduceat(mark[codes[starts[i + 1] : starts[end]]], starts[i + 1 : end] - starts[i + 1])
        mark[mine] = 0
        near = shared >= threshold * (sizes[i] + sizes[i + 1 : end] - shared) - 1e-9
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if not inner and side[i] == side[j]:
                continue
            if several[i] and several[j] and min(set(several[i]) & set(several[j])) != leader:
                continue
            links[i] += weight[j]
            links[j] += weight[i]
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    linked = np.flatnonzero(links).tolist()
    if not linked:
        return []
    return [
        pa.RecordBatch.from_arrays(
            [
                pa.array([reps[i] for i in linked], pa.binary()), pa.array(links[linked]),
                pa.array([reps[root(i)] for i in linked], pa.binary()),
            ],
            ["rep", "links", "root"],
        )
    ]


def near_classes(
    docs: DataFrame, threshold: float, recall: float, id_column: str, text: str
) -> tuple[DataFrame, DataFrame]:
    """Signed rows ``id, digest``, and per digest its ``links`` and ``component`` (a digest)."""
    bands, rows = banding(threshold, recall)
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    signed = stored(_signed(narrow, bands, rows), "signed")
    classes = (
        signed.where("digest is not null").groupBy(F.col("digest").alias("rep"), "bands")
        .agg(F.count("*").alias("weight"), F.min("id").alias("id"))
    )
    classes = stored(classes, "classes")
    buckets = classes.select("rep", F.posexplode("bands").alias("band", "hash"))
    led = buckets.groupBy("band", "hash").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = splittable_join(buckets, led, ["band", "hash"]).groupBy("rep", "leader").agg(F.lit(1).alias("one")).drop("one")
    members = stored(members, "members")
    sizes = members.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    leaders = members.groupBy("rep").agg(F.collect_list("leader").alias("leaders"))  # one per band at most
    wanted = classes.join(leaders, "rep").select("rep", "weight", "leaders", "id")
    wanted = stored(wanted, "wanted")

    sets = _sets(narrow, wanted)
    placed = splittable_join(members, wanted.select("rep", "weight", "leaders"), ["rep"])
    placed = splittable_join(placed, sizes, ["leader"])
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other")).drop("other", "blocks")
    full = splittable_join(placed, sets, ["rep"])
    with rows_per_batch(docs.sparkSession, 1000):
        found = stored(
            by_group(full, ["leader", "p", "q"], lambda t: compare_block(t, threshold), "rep binary, links long, root binary"), "near"
        )
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per_class = classes.select("rep", "weight").join(counts, "rep", "left").join(named.withColumnRenamed("node", "rep"), "rep", "left")
    return signed.select("id", "digest"), per_class.select(
        F.col("rep").alias("digest"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"),
        F.coalesce("component", "rep").alias("component"),
    )


def near_groups(
    docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: id, ``class_id`` (smallest id reachable by links), ``n_links``, ``kept``."""
    signed, classes = near_classes(docs, threshold, recall, id_column, text)
    rows = stored(splittable_join(signed, classes, ["digest"], "left"), "classed")
    smallest = rows.where("component is not null").groupBy("component").agg(F.min("id").alias("class_id"))
    named = splittable_join(rows, smallest, ["component"], "left")
    class_id = F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("class_id"))
    return named.select(
        F.col("id").alias(id_column), class_id.alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        class_id.eqNullSafe(F.col("id")).alias("kept"),
    )


def without_near_copies(
    docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One document of each group, that with the smallest id, with all columns; texts without words all stay.

    Where several rows of a group have the smallest id, these stay.
    """
    groups = near_groups(docs, threshold, recall, id_column, text)
    dropped = groups.where(~F.col("kept")).select(F.struct(F.col(id_column).alias("id")).alias("_key")).distinct()
    # The documents' columns go as one, so that none of their names can meet ours.
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), F.struct(F.col(id_column).alias("id")).alias("_key"))
    return keyed.join(dropped, "_key", "left_anti").select("_doc.*")
