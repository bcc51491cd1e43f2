"""The corpus pipeline: documents to training shards in five stages (quire.llm.stages).

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and reread as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.stages import STAGES, TARGETS, run_stages

__all__ = ["ORACLE_SQL", "STAGES", "TARGETS", "run"]

#: The classifiers, the fingerprints and the fitted rates have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_stages(spark, sf_dir)
