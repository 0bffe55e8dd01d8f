"""Addresses relative to a page, as RFC 3986 resolves them, in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five parts of an address, each with the sign that tells it from an empty one.
_PARTS = r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def parts(address: Column) -> list[Column]:
    """Scheme, authority, path, query and fragment with their signs; empty where the address has none."""
    return [F.regexp_extract(address, _PARTS, i) for i in range(1, 6)]


def without_dots(path: Column) -> Column:
    """The path without its ``.`` and ``..`` segments; the latter take the segment before with them."""
    segments = F.split(path, "/", -1)
    rooted = path.startswith("/")
    inner = F.when(rooted, F.slice(segments, 2, F.greatest(F.lit(0), F.size(segments) - 1))).otherwise(segments)
    last = F.element_at(segments, -1)
    nothing = F.array().cast("array<string>")

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == ".", kept)
            .when(segment == "..", F.slice(kept, 1, F.greatest(F.lit(0), F.size(kept) - 1)))
            .otherwise(F.concat(kept, F.array(segment)))
        )

    kept = F.aggregate(inner, nothing, step)
    # A dot segment at the end leaves its slash.
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))


def tidied(written: Column) -> Column:
    """An address as written in a page, without blanks and control signs around it and line breaks or tabs inside."""
    return F.regexp_replace(F.regexp_replace(written, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")


def _once(values: list[Column], body) -> Column:
    """``body`` of the values, each worked out a single time however often the body names it."""
    held = F.named_struct(*[x for i, v in enumerate(values) for x in (F.lit(f"v{i}"), v)])
    return F.get(F.transform(F.array(held), lambda h: body(*[h[f"v{i}"] for i in range(len(values))])), F.lit(0))


def resolved(address: Column, base: Column) -> Column:
    """``address`` against the absolute address ``base``; null if it is null, or if it is relative and the base is null."""
    return _once([*parts(address), *parts(base)], _resolved)


def _resolved(scheme, authority, path, query, fragment, base_scheme, base_authority, base_path, base_query, _) -> Column:
    folder = F.regexp_extract(base_path, r"(?s)^(.*/)", 1)
    merged = F.when((base_authority != "") & (base_path == ""), F.concat(F.lit("/"), path)).otherwise(F.concat(folder, path))
    whole = (scheme != "") | (authority != "") | path.startswith("/")
    way = F.when(whole, path).when(path == "", base_path).otherwise(merged)
    # An address by scheme alone, such as that of a mail, has no segments; the empty one takes the base's path as it is.
    dotted = F.when(whole, path.startswith("/")).otherwise(path != "")
    same_page = (scheme == "") & (authority == "") & (path == "") & (query == "")
    return F.concat(
        F.when(scheme != "", scheme).otherwise(base_scheme),
        F.when((scheme != "") | (authority != ""), authority).otherwise(base_authority),
        _once([way, dotted], lambda w, d: F.when(d, without_dots(w)).otherwise(w)),
        F.when(same_page, base_query).otherwise(query),
        fragment,
    )
