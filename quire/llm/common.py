"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; every other code point stays."""
    return F.translate(c, UPPER, LOWER)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names a shared folder in spark.checkpoint.dir. Where that is unset, a local one is made in local mode only (tests):
    executors elsewhere could not read it."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
        return
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quire-checkpoints-"))


def _is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return bool(re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master))


def settle(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage in the shared checkpoint folder, so that lost executors cost no recomputation.

    On a cluster the driver's collector runs afterwards: shuffles that nothing refers to any more are then deleted from the executors'
    disks, and so are checkpoints if Spark is told to clean them."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if not _is_local(df.sparkSession):
        gc.collect()
        df.sparkSession._jvm.System.gc()
    return out


def unit_hash(*cols: Column) -> Column:
    """A uniform double in [0, 1) that only depends on the values."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
