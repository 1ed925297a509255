"""Files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Files that a block of a large commit has, about; blocks are paired with each other, so that no key has more than two.
BLOCK_FILES = 128


def recent(commits: DataFrame, months: int, time: str = "committed_at") -> DataFrame:
    """The commits of the last ``months`` before the latest one; those without a time are left out."""
    since = commits.agg(F.add_months(F.max(time), -months) if dict(commits.dtypes)[time] == "date" else F.max(time) - F.make_ym_interval(F.lit(0), F.lit(months))).scalar()
    return commits.where(F.col(time) >= since)


def changes(commits: DataFrame) -> DataFrame:
    """(repo, commit_id, file), each once; rows without one of them are left out."""
    return commits.where("repo is not null and commit_id is not null and file is not null and file != ''").select("repo", "commit_id", "file").distinct()


def file_totals(changed: DataFrame) -> DataFrame:
    return changed.groupBy("repo", "file").agg(F.count("*").alias("total"))


def _pairs(changed: DataFrame) -> DataFrame:
    """Each two rows of a commit, the lesser file as ``a`` and the other as ``b``.

    A commit's files are dealt by hash into blocks of about ``BLOCK_FILES``; each pair of blocks is a
    key of its own, so that the pairs of a commit of any size are spread over the cluster. A commit
    of one block is sent once.
    """
    blocks = changed.groupBy("repo", "commit_id").agg(F.ceil(F.count("*") / BLOCK_FILES).alias("blocks"))
    dealt = changed.join(blocks, ["repo", "commit_id"]).withColumn("own", F.pmod(F.xxhash64("file"), F.col("blocks")))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.select("repo", "commit_id", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.struct("own", *[c for c in changed.columns if c not in ("repo", "commit_id")]).alias("row"))
    a, b = (cells.withColumnRenamed("row", side) for side in "ab")
    return a.join(b, ["repo", "commit_id", "low", "high"]).where("a.file < b.file and least(a.own, b.own) = low and greatest(a.own, b.own) = high").select("repo", "a", "b")


def co_changes(changed: DataFrame, bulk: int | None = None) -> DataFrame:
    """(repo, file_a, file_b, co_changes), file_a < file_b: commits that change both.

    All commits count. If ``bulk`` is given, a commit of more files takes no part.
    """
    if bulk is not None:
        sizes = changed.groupBy("repo", "commit_id").agg(F.count("*").alias("n")).where(F.col("n") <= bulk).select("repo", "commit_id")
        changed = changed.join(sizes, ["repo", "commit_id"], "left_semi")
    return _pairs(changed).groupBy("repo", F.col("a.file").alias("file_a"), F.col("b.file").alias("file_b")).agg(F.count("*").alias("co_changes"))


def coupling(changed: DataFrame, least_strength: float = 0.3, least_changes: int = 3) -> DataFrame:
    """(repo, file_a, file_b, co_changes, strength): strength is co-changes by the greater total of the two.

    A pair changes together at most as often as its rarer file changes; files and pairs that cannot
    reach the limits by that are left out before pairs are counted.
    """
    known = changed.join(file_totals(changed).where(F.col("total") >= least_changes), ["repo", "file"])
    greater = F.greatest("a.total", "b.total")
    pairs = _pairs(known).where(F.round(F.least("a.total", "b.total") / greater, 6) >= least_strength)
    counted = pairs.groupBy("repo", F.col("a.file").alias("file_a"), F.col("b.file").alias("file_b")).agg(F.count("*").alias("co_changes"), F.max(greater).alias("total"))
    rated = counted.where(F.col("co_changes") >= least_changes).withColumn("strength", F.round(F.col("co_changes") / F.col("total"), 6))
    return rated.where(F.col("strength") >= least_strength).select("repo", "file_a", "file_b", "co_changes", "strength")
