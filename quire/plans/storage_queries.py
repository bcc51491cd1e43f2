"""Queries of sources and sinks that need files, tables or services: what they write goes to a new folder of the shared checkpoint folder,
and is read back from there."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.lineage import shared_folder
from quire.plans.registry import query, source, table
from quire.sources import providers, services, text_reader, workbook, writers
from quire.streaming.jobs import run_jobs

# Texts as files


@query("src_02_text_files", "SELECT doc_id, md5(coalesce(text, '')) AS content, length(coalesce(text, '')) AS n FROM documents")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of its own, read back as whole texts. Files are dealt to folders, each of which is a task's."""
    services.register(spark)
    folder = shared_folder(spark, "texts")
    docs = table(spark, sf_dir, "documents")
    n = text_reader.text_tasks(docs, "text")
    files = docs.select(F.col("doc_id").cast("string").alias("book"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    dealt = files.repartitionById(n, services.folder_number(F.concat("book", F.lit(".txt")), n))
    dealt.write.format("quire_workbooks").option("suffix", ".txt").option("folders", n).mode("append").save(folder)
    read = text_reader.read_texts(spark, folder, folders=True)
    return read.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("bigint").alias("doc_id"), F.md5("raw").alias("content"), F.length("raw").cast("bigint").alias("n"))


@query("snk_12_csv", "SELECT c_custkey AS k, c_name || ', \"' || c_mktsegment || '\"' AS s, c_acctbal::DOUBLE AS b FROM customer")
def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "csv")
    writers.write_csv(source(spark, sf_dir, "SELECT c_custkey AS k, concat(c_name, ', \"', c_mktsegment, '\"') AS s, CAST(c_acctbal AS DOUBLE) AS b FROM {customer}"), folder)
    return spark.read.schema("k bigint, s string, b double").option("header", "true").option("escape", '"').csv(folder)


# The cache

EVENTS = "SELECT concat('10.1000/', user_id) AS doi, props AS metadata, true AS success, CAST(NULL AS STRING) AS error, event_type AS source, ts AS created_at, ts AS updated_at, event_id FROM {events}"
LATEST = """SELECT doi, source, updated_at FROM (SELECT '10.1000/' || user_id AS doi, event_type AS source, ts AS updated_at, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC, ts DESC, props DESC) AS r FROM events) WHERE r = 1"""


def _cache(spark: SparkSession, sf_dir: str) -> str:
    """The name of a cache of all events, in two rounds."""
    folder = shared_folder(spark, "cache")
    name = f"quire_cache_{folder.rsplit('-', 1)[1]}"
    events = source(spark, sf_dir, EVENTS)
    writers.create_cache(spark, name, buckets=16, path=folder)
    for part in (0, 1):
        writers.upsert_cache(spark, name, events.filter(F.col("event_id") % 2 == part).drop("event_id"))
    return name


@query("snk_14_cache_table", LATEST)
def cache_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(_cache(spark, sf_dir)).select("doi", "source", "updated_at")


@query("src_08_cache_lookup", f"WITH k AS ({LATEST}) SELECT o_orderkey AS k, source FROM orders LEFT JOIN k ON doi = '10.1000/' || o_custkey")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _cache(spark, sf_dir)
    refs = source(spark, sf_dir, "SELECT o_orderkey AS k, concat('10.1000/', o_custkey) AS doi FROM {orders}")
    return writers.lookup_cache(spark, name, refs).select("k", "source")


# Services


def stand_in_open(key: str) -> providers.Answer:
    kind = int(key.rsplit("/", 1)[1]) % 5
    return (200, {}, json.dumps({"title": key})) if kind < 2 else (404, {}, "") if kind < 4 else (503, {"Retry-After": "9"}, "")


def stand_in_second(key: str) -> providers.Answer:
    return (200, {}, json.dumps({"message": {"title": key}})) if int(key.rsplit("/", 1)[1]) % 5 == 2 else (418, {}, "")


@query("src_09_metadata_source", """SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN 'openalex' WHEN 1 THEN 'openalex' WHEN 2 THEN 'crossref' END AS source, s_suppkey % 5 < 3 AS success,
  CASE WHEN s_suppkey % 5 > 2 THEN 'crossref_http_418' END AS error, CASE WHEN s_suppkey % 5 < 3 THEN '10.1/' || s_suppkey END AS title FROM supplier""")
def metadata_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of every supplier from files, asked for by a data source with a rate."""
    services.register(spark)
    folder = shared_folder(spark, "keys")
    source(spark, sf_dir, "SELECT concat('10.1/', s_suppkey) AS key FROM {supplier}").repartition(4).write.parquet(folder)
    asked = [["openalex", f"{__name__}:stand_in_open"], ["crossref", f"{__name__}:stand_in_second"]]
    found = spark.read.format("quire_metadata").option("services", json.dumps(asked)).option("rate", "5000").option("wait", "0").load(folder)
    return found.select(F.substring_index("key", "/", -1).cast("bigint").alias("k"), "source", "success", "error", F.get_json_object("metadata", "$.title").alias("title"))


STATUS = "SELECT s_suppkey AS k, CASE s_suppkey % 6 WHEN 0 THEN 'completed' WHEN 1 THEN 'true' WHEN 2 THEN 'Error' WHEN 3 THEN 'RUNNING' WHEN 4 THEN 'FAILED' END AS status FROM {supplier}"


@query("src_10_pending_jobs", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 6 < 2 THEN 'done' WHEN s_suppkey % 6 IN (2, 4) THEN 'failed' WHEN s_suppkey % 6 = 3 THEN 'timeout' END AS outcome, CASE s_suppkey % 6 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'ERROR' WHEN 4 THEN 'FAILED' END AS response FROM supplier")
def pending_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for every supplier, all pending at once: each waits in the state of a stream."""
    requests = source(spark, sf_dir, STATUS).select(F.col("k").alias("key"), F.col("status").alias("payload"))
    out = run_jobs(spark, requests, shared_folder(spark, "jobs"), lambda payload: payload, lambda job: (job, job.upper()), timeout=1.0, interval=0.5)
    return out.select(F.col("key").cast("bigint").alias("k"), "outcome", "response")


# Workbooks


@query("snk_06_workbook_files", """SELECT c_nationkey AS book, c_mktsegment AS sheet, (row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) + 1)::INT AS "row", c_custkey || '|' || c_name AS cells FROM customer""")
def workbook_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation with a sheet for each segment and a row for each customer, written by tasks and read back."""
    services.register(spark)
    folder = shared_folder(spark, "workbooks")
    rows = table(spark, sf_dir, "customer")
    workbook.workbooks(rows, "c_nationkey", "c_mktsegment", ["c_custkey"], ["c_custkey", "c_name"]).write.format("quire_workbooks").mode("append").save(folder)
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"(\d+)\.xlsx$", 1).cast("int").alias("book"), "content")
    cells = workbook.workbook_cells(files).filter("row > 1")
    whole = cells.groupBy("book", "sheet", "row").agg(F.array_sort(F.collect_list(F.struct("column", "text"))).alias("t"))
    return whole.select("book", "sheet", "row", F.array_join("t.text", "|").alias("cells"))
