"""What is not in the corpus: metadata services, hosted models and downloaded lists, behind one interface.

A provider takes a DataFrame of requests and returns it with what was found. Tables and functions can be providers; a function runs where
its row is, in the order of its partition, with the retries and delays of http_outcome(). Nothing here opens a connection by itself.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.references import RETRIED

# What a job's status says.
JOB_DONE, JOB_FAILED = ("COMPLETED", "SUCCESS", "DONE", "TRUE"), ("FAILED", "ERROR")
JOB_TIMEOUT, JOB_INTERVAL, MAX_ATTEMPTS, MAX_DELAY = 300.0, 5.0, 3, 30.0

#: One answer: HTTP status, headers, body. A function raises TimeoutError or ConnectionError where there is none.
Answer = tuple[int, dict[str, str], str]
Call = Callable[[str], Answer]


class Provider(Protocol):
    def __call__(self, requests: DataFrame) -> DataFrame: ...


def from_table(answers: DataFrame, keys: Sequence[str]) -> Provider:
    """Answers that are known already: a left join by key. Keys are unique in the table."""
    return lambda requests: requests.join(answers, list(keys), "left")


def ask(key: str, name: str, call: Call, max_attempts: int = MAX_ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> tuple[dict | None, str | None]:
    """Metadata of a key from one source, or an error such as openalex_not_found. 404 and unreadable answers end at once; busy and failing
    servers are asked again after Retry-After seconds, else 2 ** attempt, at most MAX_DELAY."""
    error = None
    for attempt in range(max_attempts):
        again, delay = False, float(2**attempt)
        try:
            status, headers, body = call(key)
            if status == 200:
                try:
                    found = json.loads(body)
                except ValueError:
                    found = None
                if not isinstance(found, dict):
                    return None, f"{name}_invalid_json"
                if name == "crossref":
                    found = found.get("message")
                    if not isinstance(found, dict):
                        return None, "crossref_invalid_response"
                return found, None
            if status == 404:
                return None, f"{name}_not_found"
            error, again = f"{name}_http_{status}", status in RETRIED
            try:
                delay = min(float(headers.get("Retry-After", "")), MAX_DELAY)
            except ValueError:
                delay = min(delay, MAX_DELAY)
        except TimeoutError:
            error, again = f"{name}_timeout", True
        except ConnectionError:
            error, again = f"{name}_connection_error", True
        if not again:
            break
        if attempt + 1 < max_attempts:
            sleep(delay)
    return None, error or f"{name}_failed"


def metadata_provider(sources: Sequence[tuple[str, Call]], key: str = "doi", sleep: Callable[[float], None] = time.sleep) -> Provider:
    """Requests with the column key get metadata (JSON), source, success and error (of the last source asked). Sources are asked in order
    until one answers. Null and empty keys are not asked."""
    def provide(requests: DataFrame) -> DataFrame:
        schema = requests.selectExpr("*", "CAST(NULL AS STRING) AS metadata", "CAST(NULL AS STRING) AS source", "false AS success", "CAST(NULL AS STRING) AS error").schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for k in batch.column(key).to_pylist():
                    found, source, error = None, None, None
                    for name, call in sources if k else ():
                        found, error = ask(k, name, call, sleep=sleep)
                        if found is not None:
                            source = name
                            break
                    out.append((None if found is None else json.dumps(found), source, found is not None, error))
                added = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], schema.names)

        return requests.mapInArrow(run, schema)

    return provide


def job_state(status: Column) -> Column:
    """done, failed or pending, by the upper-cased status; null is pending."""
    s = F.upper(F.coalesce(status.cast("string"), F.lit("")))
    return F.when(s.isin(*JOB_DONE), "done").when(s.isin(*JOB_FAILED), "failed").otherwise("pending")


def poll(submit: Callable[[str], str | None], state: Callable[[str], tuple[str, str | None]], payload: str, timeout: float = JOB_TIMEOUT, interval: float = JOB_INTERVAL,
         clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str | None]:
    """Submits a job and asks for it until it ends: done and its response, or failed, timeout or no_job. state gives status and response."""
    job = submit(payload)
    if not job:
        return "no_job", None
    began = clock()
    while clock() - began <= timeout:
        status, response = state(job)
        if str(status).upper() in JOB_DONE:
            return "done", response
        if str(status).upper() in JOB_FAILED:
            return "failed", response
        sleep(interval)
    return "timeout", None


def job_provider(submit: Callable[[str], str | None], state: Callable[[str], tuple[str, str | None]], payload: str = "payload", at_once: int = 1, **options) -> Provider:
    """Requests with a payload get outcome (see poll()) and response. Null payloads are not sent. A task waits for ``at_once`` jobs at a time;
    with more than one, submit and state are called from several threads."""
    def provide(requests: DataFrame) -> DataFrame:
        schema = requests.selectExpr("*", "CAST(NULL AS STRING) AS outcome", "CAST(NULL AS STRING) AS response").schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ended = lambda p: poll(submit, state, p, **options) if p is not None else (None, None)
            with ThreadPoolExecutor(at_once) as threads:
                for batch in batches:
                    out = list((threads.map if at_once > 1 else map)(ended, batch.column(payload).to_pylist()))
                    yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[i] for x in out], pa.string()) for i in (0, 1))], schema.names)

        return requests.mapInArrow(run, schema)

    return provide


def list_file(spark: SparkSession, path: str, fetch: Callable[[str], None] | None = None) -> DataFrame:
    """file and content of a list that is fetched once: fetch(path) is called only where the path does not exist yet, on any file system
    that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        if fetch is None:
            raise FileNotFoundError(path)
        fetch(path)
    return spark.read.text(path, wholetext=True).select(F.lit(path).alias("file"), F.col("value").alias("content"))
