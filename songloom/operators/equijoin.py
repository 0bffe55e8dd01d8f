"""Equi-join that adaptive execution can split at a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no column of the frames has it; names differ by more than case."""
    taken = {column.lower() for frame in frames for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def splittable_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names; null keys meet nothing.

    Adaptive execution splits a hot key only where both sides are shuffled for the join itself. A side
    that is already grouped by the keys would be taken as it lies, and the hot key of the other side
    would be one task. A struct as join key asks for shuffles of its own; they are cheap, as the grouped
    side is small per key. A side small enough is broadcast by adaptive execution either way.
    """
    known = right
    for column in keys:
        known = known.where(F.col(column).isNotNull())
    key = free_name("_key", left, right)
    keyed = known.select(F.struct(*keys).alias(key), *[c for c in right.columns if c not in keys])
    return left.withColumn(key, F.struct(*keys)).join(keyed, key, how).drop(key)
