"""The stages of the corpus pipeline: documents to training shards.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and reread as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, mixing, quality, sharding, simhash_dedup
from quire.llm.common import ensure_checkpoint_dir, table
from quire.shipping import ship

#: Expected token shares after mixing. The clean domain keeps its tokens, the other's follow.
TARGETS = {"clean": 0.96, "toxic": 0.04}


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that nearest-neighbour voting gives at least the threshold."""
    ship(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, out="__score").filter(F.col("__score") >= quality.THRESHOLD).drop("__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near-duplicates: SimHash within 2 bits, or a similarity of 0.8 over five-word shingles."""
    ship(spark)
    return simhash_dedup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str, max_share: float = 0.5) -> DataFrame:
    """Cuts spans that occur in benchmark items out of the texts; documents that mostly consist of them go."""
    ship(spark)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    others = tuple(n for c, n in at.items() if c not in ("doc_id", "text"))
    out = decontaminate.decontaminate(docs.toDF(*names), table(spark, sf_dir, "benchmark"), max_share=max_share, doc_id=at["doc_id"], text=at["text"], keep=others)
    out = out.filter(F.col("n_hit") <= F.col("n_words") * max_share)
    own = {"doc_id": F.col("doc_id"), "text": F.col("clean")}
    if "n_chars" in at:
        own["n_chars"] = F.when(F.col("n_hit") > 0, F.length("clean").cast("bigint")).otherwise(F.col(at["n_chars"]))
    return out.select(*[own.get(c, F.col(n)).alias(c) for c, n in at.items()])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that expected domain tokens match TARGETS, as far as they can be reached."""
    labels = mixing.labelled_domains(table(spark, sf_dir, "labels"))
    return mixing.resample(docs, labels, TARGETS, anchor="clean")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of the documents, and shard and slot."""
    ship(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "size", "text_crc32", "shard", "slot")]
    return sharding.shard_by_bytes(docs, keep=others).select(*[c for c in docs.columns if c in ("doc_id", *others)], "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mixing),
    ("sharding", shard),
]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def run_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, in the shared checkpoint folder. What a stage has read is deleted once it is written."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _delete(spark, before)
        before = path
    return docs
