"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Unicode counts as whitespace, for Java regular expressions.
WHITESPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


def strip(col: Column | str) -> Column:
    """Remove Unicode whitespace at both ends.

    The lookbehind lets only the first character of an inner run start a match, so long runs cost
    linear time.
    """
    return F.regexp_replace(col, rf"\A{WHITESPACE}++|(?<!{WHITESPACE}){WHITESPACE}++\z", "")


def contains(text: Column, part: Column) -> Column:
    """Substring test; a null on either side counts as no."""
    return F.coalesce(F.contains(text, part), F.lit(False))


def without(col: Column | str, characters: str) -> Column:
    """Remove every occurrence of the given characters."""
    return F.translate(col, characters, "")


def join_words(*cols: Column | str) -> Column:
    """Texts joined by one blank; null if any is null."""
    parts: list[Column] = []
    for position, col in enumerate(cols):
        if position:
            parts.append(F.lit(" "))
        parts.append(F.col(col) if isinstance(col, str) else col)
    return F.concat(*parts)


def fill(template: str, **values: Column) -> Column:
    """Fill ``{name}`` slots of a template with columns."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if before:
            parts.append(F.lit(before))
        parts.append(values[name])
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def first_token_int(col: Column | str) -> Column:
    """First whitespace-separated token as an integer; null if it is none."""
    first = F.get(F.split(strip(col), rf"{WHITESPACE}+"), F.lit(0))
    return F.when(first.rlike(r"\A[+-]?[0-9]+\z"), first.try_cast("bigint"))


def piece(col: Column, start: Column | int, length: Column | int) -> Column:
    """Substring by code point, ``start`` counted from 0."""
    start = start if isinstance(start, Column) else F.lit(start)
    length = length if isinstance(length, Column) else F.lit(length)
    return F.substring(col, start + 1, length)


def characters(col: Column | str) -> Column:
    """The characters of a text as an array; empty for an empty text."""
    return F.filter(F.split(col, ""), lambda c: c != "")


def url(base: str, name: Column) -> Column:
    """Base address followed by the percent-encoded name."""
    return F.concat(F.lit(base), F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")))
