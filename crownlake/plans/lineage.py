"""Reliable checkpoints and the shared folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or where that is unset and all runs on this machine a temporary folder.

    A cluster without the setting is an error, as its machines would not see each other's files.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    own = getattr(sc, "_crownlake_folder", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="crownlake")
        sc._crownlake_folder = own
    return own


def checkpointed(df: DataFrame, small: bool = False) -> DataFrame:
    """``df`` from a checkpoint in the shared folder.

    ``small`` frames (ids and labels) are written in as many files as the cluster has cores, however many
    partitions a shuffle has: each file costs a process on some file systems.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return (df.coalesce(max(1, sc.defaultParallelism)) if small else df).checkpoint(eager=True)
