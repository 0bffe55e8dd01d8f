"""Row positions, keep-first deduplication, sorting and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songloom.operators.equijoin import free_name


#: Key ranges per shuffle partition; ranges are dealt by hash, and with several each task gets about as many rows.
RANGES_PER_PARTITION = 4
#: Steps of the search for a row's range; two to this power is the largest number of ranges.
SEARCH_STEPS = 20


def _in_order(keys: list[str], descending: Sequence[str]) -> list[Column]:
    return [F.desc(k) if k in descending else F.asc(k) for k in keys]


def _not_behind(bound: Column, keys: list[str], descending: Sequence[str]) -> Column:
    """Whether ``bound`` is at or before the row; ascending keys have nulls first, descending ones last."""
    result = F.lit(True)
    for key in reversed(keys):
        mine, its = F.col(key), bound[key]
        low, high = (mine, its) if key in descending else (its, mine)
        before = F.when(low.isNull(), True).when(high.isNull(), False).otherwise(low < high)
        result = F.when(its.eqNullSafe(mine), result).otherwise(before)
    return result


def range_index(df: DataFrame, keys: list[str], descending: Sequence[str] = ()) -> DataFrame:
    """First key ``first`` of each range of keys, and the number ``offset`` of rows before it.

    Only the keys are shuffled. Equal keys are in one range, so a row's range follows from its key alone.
    """
    order = _in_order(keys, descending)
    # A number of its own, as ranges of keys that look small may hold large rows.
    parts = RANGES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.select(*keys).repartitionByRange(min(parts, 1 << SEARCH_STEPS), *order).sortWithinPartitions(*order)
    # A generated id holds the partition in its upper bits and the place in it in its lower 33 bits.
    marked = placed.select(F.struct(*keys).alias("key"), F.monotonically_increasing_id().alias("at"))
    ranges = marked.groupBy(F.shiftright("at", 33).alias("range")).agg(
        F.min_by("key", "at").alias("first"), F.count("*").alias("rows")
    )
    # One row per partition from here on.
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select("range", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))


def with_row_index(df: DataFrame, keys: list[str], name: str = "row_idx", descending: Sequence[str] = ()) -> DataFrame:
    """Number the rows 0, 1, 2 ... in the order of ``keys``, which must order the rows totally.

    An index of key ranges is made of the keys alone; every row finds its range in it by a binary search and
    is numbered there, so that no single task sees the whole table. Nothing is stored, and the numbers are
    the same whenever a task is run again: they depend on the keys, not on where a row lies.
    """
    found, offset = free_name("_ranges", df), free_name("_offset", df)
    ranges = range_index(df, keys, descending)
    ordered = ranges.agg(F.array_sort(F.collect_list(F.struct("range", "first", "offset"))))
    searched = F.aggregate(
        F.array(*[F.lit(1 << s) for s in reversed(range(SEARCH_STEPS))]),
        F.lit(0),
        lambda at, step: F.when(
            (at + step < F.size(found)) & _not_behind(F.get(F.col(found), at + step)["first"], keys, descending), at + step
        ).otherwise(at),
    )
    placed = df.withColumn(found, ordered.scalar()).withColumn(offset, F.get(F.col(found), searched)["offset"]).drop(found)
    within = F.row_number().over(Window.partitionBy(offset).orderBy(*_in_order(keys, descending)))
    return placed.withColumn(name, F.col(offset) + within - 1).drop(offset)


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First row of each key in the given order; null keys are one group.

    The rank limit is applied before the shuffle as well, so a key with very many copies sends one row
    per map task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """Different values of the columns, unordered."""
    return df.select(*columns).distinct()


def sort_by(df: DataFrame, columns: list[str], tie_break: str | None = None) -> DataFrame:
    """Ascending sort with nulls last; the tie-break makes the order total."""
    order = [F.col(c).asc_nulls_last() for c in columns]
    return df.orderBy(*order, *([tie_break] if tie_break else []))


def sorted_distinct(df: DataFrame, column: str) -> DataFrame:
    """Different values of a column, sorted, nulls last."""
    return df.select(column).distinct().orderBy(F.col(column).asc_nulls_last())


def first_rows(df: DataFrame, order: list[str | Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows in a total order."""
    return df.orderBy(*order).limit(n)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Different rows of the left table that are not in the right one; both lose copies before they meet."""
    return left.distinct().subtract(right.distinct())


def append_rows(stored: DataFrame, new: DataFrame, order: str = "row_idx") -> DataFrame:
    """Stored rows followed by new ones, whose positions are moved behind the last stored position."""
    behind = F.coalesce(stored.agg(F.max(order)).scalar() + 1, F.lit(0))
    moved = new.withColumn(order, F.col(order) + behind)
    return stored.unionByName(moved, allowMissingColumns=True)
