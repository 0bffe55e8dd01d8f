"""Exact deduplication by an extendible-hash index on shared files, in DataFrame operations only.

A text's address is a hash of it. The directory is made of the different addresses: it has one slot at first and
doubles until no bucket is overfull; a bucket that holds too many splits by one more bit of the address, the others
keep their depth and several slots point to them. Every row finds its bucket through the directory.

Rows go to the owner task of their address range within a bucket; copies are combined before, so a group of any size is
one row of each task. The owner compares bytes: the smallest and the largest text of an address are the same string, or
the address has a collision. An address without one is one entry of the index. Texts that collide form a chain, with
an entry for each, and their rows look for their own text in it, byte by byte. No digest takes part in any
decision. The index is written to the shared folder in order of buckets and read from there.

Equality is that of the texts after A-Z are lower-cased; all other characters count as they are.

Defined cases: a null text is empty; a null id is smaller than any other; of rows with the same text and id one
is kept; an empty table gives no rows; other columns are ignored by ``exact_groups`` and kept by ``without_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.operators.equijoin import splittable_join
from songloom.session import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Entries that a bucket holds before it splits.
BUCKET_ENTRIES = 100_000


def normalised(text: str) -> Column:
    """A-Z lower-cased, nothing else; pure ASCII takes the faster way to the same result."""
    held = F.coalesce(F.col(text), F.lit(""))
    ascii_only = F.octet_length(held) == F.length(held)
    return F.when(ascii_only, F.lower(held)).otherwise(F.translate(held, UPPER, UPPER.lower()))


def _address(norm: str, address_bits: int) -> Column:
    return F.xxhash64(norm).bitwiseAND(F.lit((1 << address_bits) - 1).cast("long"))


def _low(column: str, bits: Column) -> Column:
    """The low ``bits`` bits; ``bits`` is below 63."""
    return F.col(column).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int")) - 1)


def directory(addresses: DataFrame, bucket_entries: int, deepest: int) -> DataFrame:
    """Directory of ``2 ** deepest`` slots at most: ``slot`` and the local ``depth`` of its bucket.

    A slot's bucket is found by doubling: with one more bit at a time, the first that is not overfull.
    """
    slots = addresses.groupBy(_low("_address", F.lit(deepest)).alias("slot")).agg(F.count("*").alias("n"))
    tried = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("depth"))
    tried = tried.withColumn("bucket", _low("slot", F.col("depth")))
    fill = tried.groupBy("depth", "bucket").agg(F.sum("n").alias("filled"))
    fits = fill.where((F.col("filled") <= bucket_entries) | (F.col("depth") == deepest)).select("depth", "bucket")
    return tried.join(fits, ["depth", "bucket"]).groupBy("slot").agg(F.min("depth").alias("depth"))


def _in_buckets(keyed: DataFrame, bucket_entries: int) -> DataFrame:
    """Rows with the ``_bucket`` of their address."""
    addresses = stored(keyed.select("_address").distinct(), "addresses")
    deepest, total = 0, addresses.count()
    # Deep enough that buckets of hashed addresses are far from full at the deepest level.
    while (bucket_entries << deepest) < 8 * total:
        deepest += 1
    slots = stored(directory(addresses, bucket_entries, deepest), "directory")
    found = keyed.withColumn("_slot", _low("_address", F.lit(deepest))).join(
        slots.withColumnRenamed("slot", "_slot").withColumnRenamed("depth", "_depth"), "_slot"
    )
    return found.withColumn("_bucket", _low("_address", F.col("_depth"))).drop("_slot", "_depth")


def _owned(placed: DataFrame) -> DataFrame:
    """What the owners find per address: number of rows, largest id, first text, and whether another one is there."""
    seen = placed.groupBy("_bucket", "_address").agg(
        F.count("*").alias("group_size"), F.max("_id").alias("keep_id"), F.min("_norm").alias("_first"), F.max("_norm").alias("_last")
    )
    digest = F.sha2(F.encode("_first", "UTF-8"), 256).alias("text_sha256")
    return seen.select("_bucket", "_address", "group_size", "keep_id", digest, (F.col("_first") != F.col("_last")).alias("_collides"))


def build_index(keyed: DataFrame, bucket_entries: int = BUCKET_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """The rows with ``_bucket`` and ``_chained``, and the index, on shared files in order of buckets.

    ``_chained`` is a row's text if its address has a collision, else null; with bucket and address it is the key
    of the index, whose entries hold ``group_size, keep_id, text_sha256``.
    """
    placed = _in_buckets(keyed, bucket_entries)
    owned = stored(_owned(placed), "owned")
    collided = owned.where("_collides").select("_bucket", "_address", F.lit(True).alias("_met"))
    nothing = F.lit(None).cast("string").alias("_chained")
    entries = owned.where("not _collides").select("_bucket", "_address", nothing, "group_size", "keep_id", "text_sha256")
    if collided.isEmpty():
        placed = placed.select("*", nothing)
    else:
        met = placed.join(collided, ["_bucket", "_address"], "left")
        placed = met.withColumn("_chained", F.when(F.col("_met"), F.col("_norm"))).drop("_met")
        chains = placed.where(F.col("_chained").isNotNull()).groupBy("_bucket", "_address", "_chained").agg(
            F.count("*").alias("group_size"), F.max("_id").alias("keep_id")
        )
        entries = entries.unionByName(chains.withColumn("text_sha256", F.sha2(F.encode("_chained", "UTF-8"), 256)))
    order = ["_bucket", "_address", "_chained"]
    return placed, stored(entries.repartitionByRange(*order).sortWithinPartitions(*order), "index")


def _keyed(docs: DataFrame, id_column: str, text: str, address_bits: int, *others: Column) -> DataFrame:
    keyed = docs.select(F.col(id_column).alias("_id"), normalised(text).alias("_norm"), *others)
    return keyed.withColumn("_address", _address("_norm", address_bits))


def _entry() -> Column:
    """Key of an index entry; a struct, so that null in it equals null."""
    return F.struct("_bucket", "_address", "_chained").alias("_entry")


def _looked_up(placed: DataFrame, index: DataFrame) -> DataFrame:
    """``_id, _entry, copies`` and the entry's columns; identical rows are one row with their number."""
    rows = placed.groupBy("_id", "_bucket", "_address", "_chained").agg(F.count("*").alias("copies"))
    found = index.select(_entry(), "group_size", "keep_id", "text_sha256")
    return splittable_join(rows.select("_id", _entry(), "copies"), found, ["_entry"])


def exact_groups(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", bucket_entries: int = BUCKET_ENTRIES,
    address_bits: int = 62,
) -> DataFrame:
    """One row per document: id, ``keep_id, group_size, kept, text_sha256``. The largest id of a group is kept.

    ``address_bits`` shortens the hash addresses; results stay the same, chains get longer.
    """
    rows = _looked_up(*build_index(_keyed(docs, id_column, text, address_bits), bucket_entries))
    each = rows.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(
        F.col("_id").alias(id_column), "keep_id", "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1)).alias("kept"), "text_sha256",
    )


def without_copies(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", bucket_entries: int = BUCKET_ENTRIES,
    address_bits: int = 62,
) -> DataFrame:
    """The documents that are kept, with all their columns.

    Of rows with the same id and equal texts the one with the smallest text stays, or any of identical ones.
    """
    # The documents' columns go as one, so that none of their names can meet one of ours.
    whole = F.struct(*docs.columns).alias("_doc")
    placed, index = build_index(_keyed(docs, id_column, text, address_bits, whole), bucket_entries)
    rows = stored(_looked_up(placed, index), "groups")
    chosen = F.col("_id").eqNullSafe(F.col("keep_id"))
    key = lambda rows: rows.select(F.struct("_id", "_entry").alias("_key"))
    dropped, doubled = key(rows.where(~chosen)), key(rows.where(chosen & (F.col("copies") > 1)))
    keyed = placed.select("_doc", F.struct("_id", _entry()).alias("_key"))
    kept = keyed.join(dropped.unionByName(doubled), "_key", "left_anti").select("_doc")
    if not doubled.isEmpty():
        least = F.min_by("_doc", F.coalesce(F.col("_doc")[text], F.lit(""))).alias("_doc")
        kept = kept.unionByName(keyed.join(doubled, "_key", "left_semi").groupBy("_key").agg(least).select("_doc"))
    return kept.select("_doc.*")
