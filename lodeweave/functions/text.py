"""Column functions on text: tokenisers, prefixes and node texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of ``[a-z0-9]`` of at least two characters, in order; empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)


def code_tokens(text: Column) -> Column:
    """The set of a name's lower-case parts: the whole, its pieces at ``_ . -`` and white space, at camel case and at digits."""
    text = F.coalesce(text, F.lit(""))
    camel = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    digits = lambda t: F.regexp_replace(F.regexp_replace(t, "([A-Za-z])([0-9])", "$1 $2"), "([0-9])([A-Za-z])", "$1 $2")
    pieces = [F.split(F.lower(t), r"[_.\-\s]+") for t in (text, camel, digits(text), digits(camel))]
    return F.array_distinct(F.concat(F.array(F.lower(text)), F.filter(F.concat(*pieces), lambda t: t != "")))


def byte_prefix(text: Column, n: int) -> Column:
    """The first ``n`` bytes of the UTF-8 text, a cut character replaced."""
    return F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, n).cast("string"))


def describe(label: Column, name: Column, path: Column, signature: Column, content: Column, class_name: Column) -> Column:
    """A node's text for embedding, with the first 500 bytes of its code; empty parts are skipped."""
    part = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c))
    return F.concat_ws(
        ". ", F.concat_ws(" ", label, name), part("in file ", path), part("Signature: ", signature), part("Code: ", byte_prefix(content, 500)), part("Method of class ", class_name)
    )


def short_text(label: Column, name: Column, signature: Column, path: Column) -> Column:
    return F.concat_ws(" ", *(F.when(F.coalesce(c, F.lit("")) != "", c) for c in (label, name, signature, path)))
