"""Section trees of text files as they arrive: a file stream, one batch of documents at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.sections import extract_sections, section_records


def stream_sections(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Reads whole text files of a folder as they arrive and appends their sections to Parquet under ``out``.

    Documents are independent, so no state is kept. Each batch writes its own folder and replaces it when it is run again, so a
    restarted query adds no section twice."""
    files = spark.readStream.format("text").option("wholetext", "true").load(folder)
    docs = files.select(F.col("_metadata.file_path").alias("doc_id"), F.make_valid_utf8("value").alias("raw"))

    def write(batch: DataFrame, number: int) -> None:
        section_records(extract_sections(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
