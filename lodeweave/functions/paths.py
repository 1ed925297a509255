"""Column functions on paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dirname(path: Column) -> Column:
    """All before the last slash; empty if there is none."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last dot and what follows, in lower case; empty if the name has none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    """The path without its extension."""
    return F.regexp_replace(path, r"\.[^./]+$", "")


def ancestors(path: Column) -> Column:
    """Every folder above a path, the longest last; empty for a path without a folder."""
    parts = F.split(path, "/")
    upto = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(upto, lambda n: F.array_join(F.slice(parts, 1, n), "/"))
