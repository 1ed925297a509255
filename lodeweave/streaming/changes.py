"""Changes as a stream: batches closed by silence, and incremental re-indexing."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.parsers import parse_calls, parse_imports, parse_symbols, parse_types


def quiet_batches(events: DataFrame, time: str, path: str, gap: str, *keys: str, late: str | None = None) -> DataFrame:
    """(keys, start, end, changes, paths): events until ``gap`` of silence, a path once in each batch.

    For a stream give ``late``, how late events may come; the same call works on a table.
    """
    rows = events.withColumn("_t", F.col(time).cast("timestamp")).where("_t is not null")
    if late:
        rows = rows.withWatermark("_t", late)
    batch = rows.groupBy(*keys, F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("changes"), F.collect_set(path).alias("paths"))
    return batch.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes", F.size("paths").alias("paths"))


def route(previous: DataFrame, current: DataFrame, key: str = "rel_path", state: str = "sha256") -> DataFrame:
    """(key, change): what was added, modified or deleted between two snapshots."""
    a = previous.select(F.col(key), F.col(state).alias("_a"), F.lit(1).alias("_old"))
    b = current.select(F.col(key), F.col(state).alias("_b"), F.lit(1).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def reindex_into(target: str, key: str = "file_path", buckets: int = 64):
    """A ``foreachBatch`` sink that replaces the rows of every file in the batch and keeps all others.

    The table under ``target`` is partitioned by a hash bucket of the key; only the buckets that the
    batch touches are rewritten, from a checkpoint that outlives lost executors. ``buckets`` holds for
    the table's life: choose it so that a bucket is a few GB. A repeated batch gives the same table.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # as many as there are buckets
        if not touched:
            return
        try:
            old = spark.read.parquet(target).where(F.col("bucket").isin(touched))
            kept = old.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            kept = fresh  # no table yet
        kept = kept.checkpoint()
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)

    return sink


def reindex_files(targets: dict[str, str], buckets: int = 64, after: Callable[[SparkSession], None] | None = None):
    """A ``foreachBatch`` sink for changed files (file_id, repo, rel_path, content; null content for a deleted one).

    Runs the phases that need a file alone, symbols, imports, calls and types, and puts their rows in the
    tables under ``targets`` (symbols, imports, calls, types: path) in place of the files' old ones.
    ``after`` is called when a batch is done, for the phases over the whole graph: see ``at_most_every``.
    """
    phases = {"symbols": parse_symbols, "imports": parse_imports, "calls": parse_calls, "types": parse_types}

    def sink(batch: DataFrame, number: int) -> None:
        files = batch.where("file_id is not null and repo is not null and rel_path is not null").checkpoint()
        paths = files.select(F.concat_ws("/", "repo", "rel_path").alias("file_path")).distinct()
        for name, target in targets.items():
            found = phases[name](files)
            gone = paths.join(found.select("file_path").distinct(), "file_path", "left_anti")  # files without rows lose their old ones too
            marks = gone.select("file_path", *(F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema if f.name != "file_path"))
            reindex_into(target, "file_path", buckets)(found.unionByName(marks), number)
        if after is not None:
            after(batch.sparkSession)

    return sink


def at_most_every(seconds: float, step: Callable[[SparkSession], None], clock: Callable[[], float] = time.monotonic) -> Callable[[SparkSession], None]:
    """Calls ``step`` unless it ran less than ``seconds`` ago; the first time it always runs."""
    last: list[float] = []

    def run(spark: SparkSession) -> None:
        now = clock()
        if not last or now - last[0] >= seconds:
            last[:] = [now]
            step(spark)

    return run
