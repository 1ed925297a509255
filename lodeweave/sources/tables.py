"""Reading the engine's tables, spreading small inputs over the cluster, and keeping intermediate tables."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``base`` (a file or a directory of part files)."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in at least as many partitions as the cluster runs tasks at once.

    A table of many files is returned as it is, without a shuffle; only an input of a few small
    files, which would keep most cores idle through a Python stage, is redistributed. Project before.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)


def shared_folder(spark: SparkSession) -> str:
    """The folder shared by all executors, from ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder of its own; on a cluster, whose machines
    don't share one, it is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", conf)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def stored(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written as a Parquet table of its own in the shared folder, partitioned ``by``, and read from there.

    Cuts the lineage as a checkpoint does; columns and partitions that a later step doesn't need are
    not read again.
    """
    path = f"{shared_folder(df.sparkSession)}/lodeweave-{uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
