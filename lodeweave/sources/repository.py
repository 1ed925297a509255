"""Source files from a folder, ignore patterns, and a captured commit log."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.paths import extension

# Patterns that are always ignored (besides a tool's own folder), and the languages of extensions.
IGNORED = (
    ".git/", "node_modules/", "__pycache__/", ".venv/", "venv/", ".tox/", ".eggs/", "*.egg-info/", ".pytest_cache/", ".mypy_cache/", "coverage/", "htmlcov/", ".coverage",
    "*.pyc", "*.pyo", "*.pyd", ".DS_Store", "Thumbs.db",
)
#: Build results and locks, which are ignored as well by default.
ALSO_IGNORED = ("dist/", "build/", ".idea/", ".vscode/", "*.min.js", "*.lock")
LANGUAGES = {".py": "python", ".go": "go", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript"}


def language_of(path: Column) -> Column:
    """The language of a path's extension; null for others."""
    ext = extension(path)
    return F.coalesce(*(F.when(ext == e, F.lit(lang)) for e, lang in LANGUAGES.items()))


def pattern_regex(pattern: str) -> str | None:
    """An ignore pattern as a regular expression over ``/path``; null for blanks and remarks."""
    pattern = pattern.strip()
    if not pattern or pattern[0] == "#":
        return None
    folder, anchored = pattern.endswith("/"), "/" in pattern.rstrip("/")
    body = re.escape(pattern.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return ("^/" if anchored else "/") + body + ("/" if folder else "(?:/|$)")


def is_ignored(path: Column, patterns: tuple[str, ...] = IGNORED + ALSO_IGNORED) -> Column:
    """Does a pattern match the path or a folder above it? The last one that matches decides; ``!`` takes back."""
    found = F.lit(False)
    positive: list[str] = []

    def any_of(rules: list[str]) -> Column:
        return F.concat(F.lit("/"), path).rlike("|".join(f"(?:{r})" for r in rules)) if rules else F.lit(False)

    for p in patterns:
        back = p.strip().startswith("!")
        rule = pattern_regex(p.strip().removeprefix("!").removeprefix("\\"))
        if rule is None:
            continue
        if back:
            found, positive = (found | any_of(positive)) & ~any_of([rule]), []
        else:
            positive.append(rule)
    return found | any_of(positive)


def read_ignore_file(spark: SparkSession, root: str) -> tuple[str, ...]:
    """The patterns of ``.gitignore`` in a repository's root, in their order; none if there is no such file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.gitignore")  # file sources leave out hidden files
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return ()
    stream = system.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return tuple(p for line in text.splitlines() if (p := line.strip()) and p[0] != "#")


def changed_sources(changed: DataFrame, path: str = "file", patterns: tuple[str, ...] = IGNORED) -> DataFrame:
    """The changed paths that are source files and not ignored."""
    return changed.where(language_of(F.col(path)).isNotNull() & ~is_ignored(F.col(path), patterns))


def scan(spark: SparkSession, root: str, patterns: tuple[str, ...] | None = None) -> DataFrame:
    """(path, rel_path, language, content, sha256) of the source files below ``root``; without those that
    ``patterns`` ignore: if not given, the usual ones and those of its ``.gitignore``."""
    patterns = IGNORED + ALSO_IGNORED + read_ignore_file(spark, root) if patterns is None else patterns
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub("^file:/*", "/", root.rstrip("/"))
    path = F.regexp_replace("path", "^file:/*", "/")
    rel = F.expr(f"substr(regexp_replace(path, '^file:/*', '/'), {len(base) + 2})")
    rows = files.select(path.alias("path"), rel.alias("rel_path"), "content")
    return rows.where(language_of(F.col("rel_path")).isNotNull() & ~is_ignored(F.col("rel_path"), patterns)).select("path", "rel_path", language_of(F.col("rel_path")).alias("language"), "content", F.sha2("content", 256).alias("sha256"))


def commit_log(lines: DataFrame) -> DataFrame:
    """(commit_id, file) of a log whose blocks start with ``COMMIT:<id>`` and go on with one file a line.

    ``lines`` (value) are the blocks, read with ``COMMIT:`` as the line separator, so that a log of any
    length is split without an order over all of it.
    """
    parts = F.split("value", r"\r?\n")
    rows = lines.select(F.trim(F.element_at(parts, 1)).alias("commit_id"), F.explode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).alias("file"))
    return rows.select("commit_id", F.trim("file").alias("file")).where("file != '' and commit_id != ''")


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    return commit_log(spark.read.option("lineSep", "COMMIT:").text(path))
