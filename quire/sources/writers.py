"""Sinks: reports as CSV and JSON, workbook sheets as partitions, and the metadata cache as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import sheet_name
from quire.lineage import settle
from quire.operators.references import latest_metadata

CACHE_SCHEMA = "doi STRING NOT NULL, metadata STRING, success BOOLEAN NOT NULL, error STRING, source STRING, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL"
#: The table's property that holds its number of buckets.
BUCKETS = "quire.buckets"
OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def write_csv(rows: DataFrame, path: str) -> None:
    """Comma-separated text with a header in every file; arrays must be joined before."""
    rows.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_sheets(rows: DataFrame, path: str, document: str = "document") -> None:
    """One folder per workbook sheet; a sheet is named after its document."""
    sheets = rows.withColumn("sheet", sheet_name(F.col(document)))
    sheets.repartition("sheet").write.mode("overwrite").partitionBy("sheet").option("header", "true").csv(path)


def cache_bucket(doi: Column, buckets: int) -> Column:
    """The partition of the cache that holds a key."""
    return F.pmod(F.xxhash64(doi), F.lit(buckets)).cast("int")


def create_cache(spark: SparkSession, table: str, buckets: int = 64, path: str | None = None) -> None:
    """A table of metadata by DOI, partitioned by a hash of the DOI into a fixed number of buckets. With path, the rows are kept there."""
    where = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({CACHE_SCHEMA}, bucket INT) USING parquet PARTITIONED BY (bucket){where} TBLPROPERTIES ('{BUCKETS}' = '{buckets}')")


def _buckets(spark: SparkSession, table: str) -> int:
    return int(spark.sql(f"SHOW TBLPROPERTIES {table} ('{BUCKETS}')").first()["value"])


def upsert_cache(spark: SparkSession, table: str, changes: DataFrame) -> int:
    """Replaces or adds the rows of changes (latest of each doi); returns how many buckets were written.

    Only the buckets that hold a key of changes are read and written, each by dynamic overwrite: work and files grow with the changes'
    spread, not with the table. Merged rows are settled in the shared checkpoint folder before anything is overwritten. New files replace
    a bucket's old ones when all tasks are done; if the driver is lost while they do, the same call again gives the same table. One call
    at a time."""
    n = _buckets(spark, table)
    new = settle(latest_metadata(changes).withColumn("bucket", cache_bucket(F.col("doi"), n)))
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most the number of buckets
    if not touched:
        return 0
    known = spark.table(table)
    old = known.filter(F.col("bucket").isin(touched)).join(new.select("bucket", "doi"), ["bucket", "doi"], "left_anti")
    merged = settle(old.select(*known.columns).unionByName(new.select(*[c for c in known.columns if c in new.columns]), allowMissingColumns=True).select(*known.columns))
    before = spark.conf.get(OVERWRITE, None)
    spark.conf.set(OVERWRITE, "dynamic")  # a table's write takes this from the session only
    try:
        merged.repartition(len(touched), "bucket").sortWithinPartitions("bucket", "doi").write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.unset(OVERWRITE) if before is None else spark.conf.set(OVERWRITE, before)
    return len(touched)


def lookup_cache(spark: SparkSession, table: str, refs: DataFrame, doi: str = "doi") -> DataFrame:
    """refs with metadata, success, error and source of the cache's row of the same DOI, nulls where there is none. The join is by bucket and
    key, so buckets that refs do not ask for are pruned while the query runs."""
    n = _buckets(spark, table)
    known = spark.table(table).select(F.col("bucket").alias("__b"), F.col("doi").alias("__d"), "metadata", "success", "error", "source")
    asked = refs.withColumn("__b", cache_bucket(F.col(doi), n))
    return asked.join(known, (asked["__b"] == known["__b"]) & (asked[doi] == known["__d"]), "left").drop("__b", "__d")


def cached_rows(spark: SparkSession, table: str, dois: list[str]) -> DataFrame:
    """The cache's rows of a few keys: the plan names their buckets, and reads no other."""
    n = _buckets(spark, table)
    wanted = [r.b for r in spark.range(1).select(F.explode(F.array(*map(F.lit, dois))).alias("d")).select(cache_bucket(F.col("d"), n).alias("b")).distinct().collect()] if dois else []
    return spark.table(table).filter(F.col("bucket").isin(wanted) & F.col("doi").isin(dois)).drop("bucket")
