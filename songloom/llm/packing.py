"""Packing documents into training sequences by minimum bin slack.

A document is its token ids and one separator id. Only documents longer than a sequence are cut; their first
piece takes the remainder, the others are full. Pieces matter by length alone, so the plan is made on the
counts per length, at most ``capacity`` numbers whatever the data: the largest length left is put in first,
a subset-sum dynamic program over bit sets finds the fullest combination of the lengths left for the rest, and
the combination is removed as often as the counts allow. Each step uses up at least one length, so the number
of combinations is bounded by the capacity as well, and the plan is what tasks are sent.

A piece finds its place by its rank among the pieces of its length: the rank inside its task, which the
encoding task counts while it writes, plus the number of such pieces in tasks before it. No window sees the
pieces of one length together, so a length that most pieces have is no hot key.

Defined cases: a null text is empty, so it is the separator alone; repeated rows and null ids are pieces of
their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from songloom.llm.common import steps
from songloom.llm.tokens import PieceIds, encoded
from songloom.session import stored


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Lengths and how often each, at most as often as counted, whose sum is the largest that fits ``room``."""
    reach, layers = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            before = reach
            reach |= (reach << (length * take)) & mask
            if reach != before:
                layers.append((before, length, take))
            left -= take
            take *= 2
        if reach >> room:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for before, length, take in reversed(layers):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return sorted(used.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Combinations and how many sequences each fills, until every piece is used."""
    left = {length: n for length, n in counts.items() if n}
    made = []
    while left:
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        if not rest[largest]:
            del rest[largest]
        combination = dict(fullest(rest, capacity - largest))
        combination[largest] = combination.get(largest, 0) + 1
        times = min(left[length] // n for length, n in combination.items())
        for length, n in combination.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
        made.append((times, sorted(combination.items(), reverse=True)))
    return made


def _slots(made: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Per length and range of ranks: first sequence, pieces of that length per sequence, offset of the first of them."""
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for times, combination in made:
        offset = 0
        for length, n in combination:
            rows.append((length, given.get(length, 0), sequence, n, offset))
            given[length] = given.get(length, 0) + n * times
            offset += length * n
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T))


def cut_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, keep_ids: bool = False,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Pieces ``id, piece, start, length, ids_crc32, task, rank`` and, where asked for, their ``ids``; lazy."""
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, task long, rank long"
    schema += ", ids array<int>" if keep_ids else ""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        pieces = PieceIds(tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in steps(batches, "text"):
            ids, starts = encoded(batch.column("text"), pieces)
            rows: list[tuple] = []
            bodies = []
            for i in range(batch.num_rows):
                body = np.append(ids[starts[i] : starts[i + 1]], np.uint32(separator)).astype("<u4")
                first = len(body) % capacity or capacity
                cuts = [0, *range(first, len(body) + 1, capacity)]
                for k, (begin, end) in enumerate(zip(cuts, cuts[1:])):
                    part = body[begin:end]
                    rows.append((i, k, begin, end - begin, zlib.crc32(part.tobytes()), seen[end - begin]))
                    seen[end - begin] += 1
                    if keep_ids:
                        bodies.append(part.astype(np.int32))
            which, k, begin, length, crc, rank = (np.array(x, np.int64) for x in zip(*rows))
            columns = [
                batch.column("id").take(pa.array(which)), pa.array(k.astype(np.int32)), pa.array(begin),
                pa.array(length), pa.array(crc), pa.array(np.full(len(which), task)), pa.array(rank),
            ]
            names = ["id", "piece", "start", "length", "ids_crc32", "task", "rank"]
            if keep_ids:
                columns.append(pa.array(bodies, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, keep_ids: bool = False,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; the pieces of a sequence follow each other without gaps.

    Pieces are written once to the shared folder; their ranks are read from there, so they cannot change.
    """
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, tokenizer, capacity, separator, keep_ids, id_column, text), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(
        Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = per_task.select("task", "length", F.coalesce(before, F.lit(0)).alias("shift"))
    # At most ``capacity`` rows, one per length.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(plan(counts, capacity)))
    ranked = pieces.join(shifts, ["task", "length"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("shift")).drop("task", "shift")
    schema = ranked.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint"

    def place(batches):
        table = slots.value
        keys = table["length"] * (1 << 45) + table["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * (1 << 45) + rank, side="right") - 1
            nth = rank - table["rank"][at]
            each = table["each"][at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(table["sequence"][at] + nth // each), pa.array(table["offset"][at] + nth % each * length)],
                [*batch.schema.names, "sequence_id", "offset"],
            )

    placed = ranked.mapInArrow(place, schema.replace(":", " "))
    return placed.drop("rank").withColumnRenamed("id", id_column)


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence, from pieces that were packed with ``keep_ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
