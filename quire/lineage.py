"""Cutting lineage: iterative operators keep what each round has found in the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only in local mode, where that is unset, a local folder is made."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quire-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
