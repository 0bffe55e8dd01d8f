"""Conversions that never fail a job on bad text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"\A\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"
INTEGER = r"\A\s*[+-]?\d+\s*\z"

# Texts which the common data-frame CSV readers take for null.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def bpm_number(col: Column | str) -> Column:
    """Text to BIGINT, fraction cut off; whatever is no finite number becomes 0.

    The pattern keeps out Java spellings such as ``1d`` that a plain cast would take.
    """
    col = (F.col(col) if isinstance(col, str) else col).cast("string")
    number = F.when(col.rlike(NUMBER), F.trim(col).try_cast("double"))
    return F.coalesce(number.try_cast("bigint"), F.lit(0).cast("bigint"))


def strict_int(col: Column | str) -> Column:
    """Integer text to BIGINT, null for any other text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col.rlike(INTEGER), F.regexp_replace(col, r"\s", "").try_cast("bigint"))


def as_text(col: Column | str, null_text: str = "nan") -> Column:
    """Text form for export, with nulls spelt out."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("string"), F.lit(null_text))


def null_tokens(df: DataFrame, tokens: Iterable[str] = ("",)) -> DataFrame:
    """Turn the given texts into nulls in every string column."""
    tokens = list(tokens)
    texts = {name for name, kind in df.dtypes if kind == "string"}
    return df.select(
        *[
            F.when(~F.col(f"`{c}`").isin(tokens), F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`")
            for c in df.columns
        ]
    )
