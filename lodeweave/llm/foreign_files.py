"""Files that the project's people did not write: generated, minified, third-party, data kept as code.

Third-party code shows itself by place, by its own statement, and by standing in several
repositories: every directory gets a Merkle hash, made bottom-up from the names and hashes of what it
holds, and a directory whose hash occurs in unrelated repositories is a copy. Headers, names and the
layout of the text tell the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import spread, stored
from .shared_spans import text_of

#: A copied directory has at least so many characters and files of this size; less is boilerplate.
LEAST_TREE, LEAST_FILE = 500, 200

# Where third-party code is kept, names of generated files, and statements in headers.
_PLACES = {
    "vendor", "_vendor", "third_party", "third-party", "thirdparty", "3rdparty", "node_modules", "bower_components", "jspm_packages",
    "site-packages", "dist-packages", "godeps", "external", "extern", "externals", "deps", "pods", "carthage",
}
_GENERATED_PATH = re.compile(r"(?:^|/)__generated__/|_pb2(?:_grpc)?\.pyi?$|\.pb\.\w+$|[._-](?:gen|generated)\.\w+$|(?:^|/)(?:zz_)?generated\.|(?:^|/)zz_generated|_string\.go$|(?:^|/)mock_\w+\.go$|_mock\.go$|\.g\.\w+$|\.designer\.\w+$", re.I)
_MINIFIED_PATH = re.compile(r"[.-]min\.(?:js|mjs|cjs|jsx|ts|css)$", re.I)
_GENERATED = re.compile(
    r"^\W*(?:code generated\b.*|.*\bdo not (?:edit|modify|touch)\b.*generat.*|.*\bgenerat\w*\b.*\bdo not (?:edit|modify|touch)\b.*|@generated\b.*|<auto-?generated\b.*|auto-?generated\b.*"
    r"|(?:this (?:file|code) (?:is|was|has been) )?(?:auto(?:matically)?[- ]?|machine[- ])generated (?:by|from|file|on|code)\b.*|this (?:file|code) (?:is|was|has been) (?:auto(?:matically)?[- ]?)?generated\b.*|machine generated\b.*"
    r"|generated by (?:the )?[\w.-]+(?: compiler| v?[\d.]+)?\.?(?:\s+do not edit.*)?|generated (?:by|from|with) \S+.*\b(?:do not|don't|changes will).*"
    r"|.*\bautomatisch\b.*\b(?:erzeugt|generiert|erstellt)\b.*|.*\bgénéré\w*\b.*\bautomatiquement\b.*|.*\bautomatiquement\b.*\bgénéré\w*\b.*|.*\bgenerad[oa]\b.*\bautomáticamente\b.*|.*\bautomáticamente\b.*\bgenerad[oa]\b.*"
    r"|.*\bgerad[oa]\b.*\bautomaticamente\b.*|.*\bgenerat[oa]\b.*\bautomaticamente\b.*|.*автоматически.*(?:сгенерирован|создан).*|.*(?:сгенерирован|создан)\w*\s.*автоматически.*|.*wygenerowan\w+.*automatycznie.*|.*automatycznie.*wygenerowan.*|.*自动生成.*|.*自動生成.*|.*자동.{0,4}생성.*|.*otomatik.*(?:oluştur|üretil).*)\W*$",
    re.I,
)
_THIRD_PARTY = re.compile(
    r"^\W*(?:this (?:file|code|module) is third[- ]party\b.*|third[- ]party (?:code|file|library|source)\b.*|imported (?:unchanged|unmodified|verbatim|as is)?\s*from (?:the )?upstream\b.*|(?:vendored|verbatim|local) copy of\b.*|vendored (?:from|in from)\b.*"
    r"|originally (?:part of|from|taken from)\b.*|(?:copied|taken|adapted|forked|borrowed|bundled) (?:verbatim |unchanged )?from (?:the )?(?:upstream|project|https?:)\b.*|.*\bv?\d+\.\d+\S*\s*\|\s*upstream:.*|upstream(?: project| source| url)?:\s*\S+.*)$",
    re.I,
)
_HEAD = re.compile(r"﻿?(?:#![^\n]*\n)?(?:\s*(?://[^\n]*|#[^\n]*|/\*.*?\*/|<!--.*?-->|[rRuU]?\"\"\".*?\"\"\"|[rRuU]?'''.*?'''|'use strict';?|\"use strict\";?))*", re.S)
_LITERAL = re.compile(r"//[^\n]*|#[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?", re.S)
_NUMBER = re.compile(r"(?<![\w$])(?:0[xXbBoO][0-9a-fA-F_]+|\d[\d_.]*(?:[eE][-+]?\d+)?)\w*")
_CODE_WORD = re.compile(r"[^\W\d]\w*")
#: Share of names in the text of data, at most; characters of bulk data, and of a bare object, at least.
DATA_WORDS, DATA_SIZE, OBJECT_SIZE = 0.1, 700, 2000
#: A minified text has most of its characters in lines of this length and little white space.
LONG_LINE, LONG_SHARE, BLANK_SHARE = 200, 0.6, 0.09


def by_path(rel_path: str | None) -> str | None:
    path = rel_path or ""
    if any(d.lower() in _PLACES for d in path.split("/")[:-1]):
        return "vendored"
    if _GENERATED_PATH.search(path):
        return "generated"
    return "minified" if _MINIFIED_PATH.search(path) else None


def by_header(text: str) -> str | None:
    """What the comments before the first statement say."""
    head = _HEAD.match(text)[0]
    for line in head.split("\n"):
        if _GENERATED.match(line):
            return "generated"
        if _THIRD_PARTY.match(line):
            return "vendored"
    return None


def by_layout(text: str) -> str | None:
    """Minified or data, by how the whole text is laid out."""
    lines = text.split("\n")
    size = len(text)
    long = sum(n for n in map(len, lines) if n >= LONG_LINE)
    dense = long >= LONG_SHARE * size and sum(map(text.count, " \t\n\r")) <= BLANK_SHARE * size
    if size < DATA_SIZE:
        return "minified" if dense and size >= LONG_LINE else None
    kept: list[str] = []
    notes, at = 0, 0
    for m in _LITERAL.finditer(text):
        kept.append(text[at : m.start()])
        at = m.end()
        if text[m.start()] in "/#" or m[0][:3] in ('"""', "'''"):
            notes += len(m[0])
    kept.append(text[at:])
    bare = _NUMBER.sub("0", " ".join(kept))
    body = size - notes - sum(map(text.count, " \t\n\r"))
    words = sum(map(len, _CODE_WORD.findall(bare)))
    if words <= DATA_WORDS * body and body >= (OBJECT_SIZE if text.lstrip("﻿ \t\r\n").startswith("{") else DATA_SIZE) and body > notes:
        return "data"
    return "minified" if dense else None


def classify(df: DataFrame) -> DataFrame:
    """(file_id, repo, rel_path, size, h1, h2, reason) of every row of files: ``reason`` by path, header or layout, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents = batch.column(2).to_pylist(), batch.column(6).to_pylist()
            reasons = []
            for path, content in zip(paths, contents):
                reason = by_path(path)
                if reason is None and content:
                    text = text_of(content)
                    reason = by_header(text) or by_layout(text)
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], batch.column(7), pa.array(reasons, pa.string())], ["file_id", "repo", "rel_path", "size", "h1", "h2", "scanned_at", "reason"])

    content = F.col("content").cast("binary")
    known = lambda h: F.when(content.isNotNull(), h)
    rows = df.select("file_id", "repo", "rel_path", F.octet_length(content).cast("long").alias("size"), known(F.xxhash64(content)).alias("h1"), known(F.xxhash64(F.lit("second"), content)).alias("h2"), content.alias("content"), F.col("scanned_at").cast("string").alias("scanned_at"))
    return spread(rows).mapInArrow(run, "file_id long, repo string, rel_path string, size long, h1 long, h2 long, scanned_at string, reason string")


def copied_directories(files: DataFrame) -> DataFrame:
    """(repo, dir): directories whose Merkle hash occurs in unrelated repositories.

    ``files`` (repo, rel_path, size, h1, h2), one row for each path. A directory's hash is a sum over
    its entries of the hash of name and content, so that it is aggregated before the shuffle however
    many entries there are. Entries are written once, by level; levels are then done one after the other
    from the deepest, each materialised, up to the root. Repositories that have one root hash are copies
    of each other as a whole and related; what only they share is no third party's.
    """
    parts = F.split("rel_path", "/")
    entries = files.where("repo is not null and rel_path is not null and h1 is not null").select("repo", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("dir"), F.element_at(parts, -1).alias("name"), "h1", "h2", "size", F.greatest("size", F.lit(0)).alias("largest"), (F.size(parts) - 1).alias("level"))
    entries = stored(entries, "level")
    deepest = entries.agg(F.max("level")).first()[0] or 0
    trees, done, above = None, None, None
    for level in range(deepest, -1, -1):
        here = entries.where(F.col("level") == level).drop("level")
        if above is not None:
            here = here.unionByName(above)
        trees = stored(
            here.groupBy("repo", "dir").agg(
                F.expr("bit_xor(xxhash64(name, h1, h2))").alias("x"), F.expr("bit_xor(xxhash64(h2, name, h1, 'second'))").alias("y"), F.count("*").alias("n"), F.sum("size").alias("size"), F.max("largest").alias("largest")
            ).select("repo", "dir", F.xxhash64("x", "n", "y").alias("h1"), F.xxhash64("y", "n", "x").alias("h2"), "size", "largest")
        )
        if level:
            done = trees if done is None else done.union(trees)
            split = F.split("dir", "/")
            above = trees.select("repo", F.array_join(F.slice(split, 1, F.size(split) - 1), "/").alias("dir"), F.element_at(split, -1).alias("name"), "h1", "h2", "size", "largest")
    if done is None:
        return entries.select("repo", "dir").limit(0)
    family = trees.select("repo", F.xxhash64("h1", "h2").alias("family"))  # the roots
    large = done.where((F.col("size") >= LEAST_TREE) & (F.col("largest") >= LEAST_FILE))
    copied = large.join(family, "repo").groupBy("h1", "h2").agg(F.min("family").alias("a"), F.max("family").alias("b")).where("a != b")
    return large.join(copied, ["h1", "h2"], "left_semi").select("repo", "dir").distinct()


def foreign_files(df: DataFrame) -> DataFrame:
    """(file_id, reason): files that are ``generated``, ``minified``, ``vendored`` or ``data``; one row each.

    Needs file_id, repo, rel_path, content and scanned_at. Trees are compared as of the latest scan of
    each path; what is found holds for all scans below them. Null content or a null path is judged by
    the other alone; empty files are no cases unless their place is; repeated rows give one.
    """
    rows = stored(classify(df).where("file_id is not null"))
    latest = rows.groupBy("repo", "rel_path").agg(F.max(F.struct("scanned_at", "file_id", "size", "h1", "h2")).alias("l")).select("repo", "rel_path", "l.size", "l.h1", "l.h2")
    parts = F.split("rel_path", "/")
    below = rows.where("reason is null and rel_path is not null and size > 0").select("file_id", "repo", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir"))
    copies = below.join(copied_directories(latest), ["repo", "dir"], "left_semi").select("file_id", F.lit("vendored").alias("reason"))
    return rows.where("reason is not null").select("file_id", "reason").union(copies).groupBy("file_id").agg(F.min("reason").alias("reason"))
