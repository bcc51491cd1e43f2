"""A registry of queries with the SQL they are compared with."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.partitions import tasks_of

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A table's name in braces.
NAME = r"\{(" + "|".join(TABLES) + r")\}"
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source(spark: SparkSession, sf_dir: str, sql: str, dealt: bool = False) -> DataFrame:
    """Runs SQL over the driver's tables; a table's name stands in braces. With ``dealt`` the tables' rows are dealt by key to counted tasks first,
    for SQL that makes long texts of short rows: a small file is one split, whatever is made of it. Views have names of their own and are dropped once the plan is
    made, so that callers do not get into each other's way."""
    views = {name: f"quire_{name}_{uuid.uuid4().hex}" for name in dict.fromkeys(re.findall(NAME, sql))}
    for name, view in views.items():
        rows = table(spark, sf_dir, name)
        (rows.repartition(tasks_of(rows), rows.columns[0]) if dealt else rows).createOrReplaceTempView(view)
    try:
        return spark.sql(re.sub(NAME, lambda m: views[m[1]], sql))
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def plain(sql: str) -> str:
    """The same SQL for an engine that knows the tables by name."""
    return re.sub(NAME, r"\1", sql)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; ``oracle`` is its SQL."""
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = plain(oracle)
        return f

    return add


#: Bytes for which one task is enough.
TASK_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out to all cores if they are few enough to have come in fewer row groups. Large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * TASK_BYTES else df


def derived(name: str, input_sql: str, oracle: str, heavy: bool = False, dealt: bool = False) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    """Registers a query that transforms the result of ``input_sql``. Its SQL is ``oracle`` with ``input_sql`` as the relation i. The rows of
    a heavy one, whose work is in each row, are spread first; ``dealt`` as in source()."""
    def add(f: Callable[[DataFrame], DataFrame]) -> Query:
        return query(name, f"WITH i AS ({input_sql}) {oracle}")(lambda spark, sf_dir: f(spread(source(spark, sf_dir, input_sql)) if heavy else source(spark, sf_dir, input_sql, dealt)))

    return add
