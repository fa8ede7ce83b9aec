"""Iteration with bounded lineage, and the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir. Where that is unset, a local master gets a folder in the warehouse;
    a cluster needs the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def repeat(df: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int, every: int = 5) -> DataFrame:
    for i in range(rounds):
        df = step(df, i)
        if (i + 1) % every == 0:
            df = settled(df)
    return df
