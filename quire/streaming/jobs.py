"""Jobs of a service as a stream with state: each job waits as a row of state with a timer, not as a task that sleeps.

A request is submitted once; from then on its job is asked for when its timer is due, in the next micro-batch, together with all others
that are due. So the number of jobs that are pending at once is bounded by the state store, not by the cores.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.sources.providers import JOB_DONE, JOB_FAILED, JOB_INTERVAL, JOB_TIMEOUT

OUTCOME = "key string, outcome string, response string"


def job_outcomes(requests: DataFrame, submit: Callable[[str], str | None], state: Callable[[str], tuple[str, str | None]], timeout: float = JOB_TIMEOUT, interval: float = JOB_INTERVAL) -> DataFrame:
    """requests: a stream of key and payload. A stream of key, outcome (done, failed, timeout or no_job) and response, each key once.

    submit gives a job for a payload, or none; state gives a job's status and response. A null payload is not sent and has a null outcome.
    A key that comes again while its job is pending changes nothing. A micro-batch that is run again after a failure submits its new
    requests again (submit should know a payload that it has seen); jobs of earlier batches are known from the state."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        def told(outcome: str | None, response: str | None = None) -> pd.DataFrame:
            return pd.DataFrame({"key": pd.Series([key[0]], dtype=object), "outcome": pd.Series([outcome], dtype=object), "response": pd.Series([response], dtype=object)})

        rows = [] if group.hasTimedOut else [p for b in batches for p in b["payload"]]
        if group.exists:
            job, began = group.get
        else:
            payload = rows[0]
            job, began = (None if payload is None else submit(payload)), time.time()
            if not job:
                yield told(None if payload is None else "no_job")
                return
        status, response = state(job)
        if str(status).upper() in JOB_DONE:
            out = told("done", response)
        elif str(status).upper() in JOB_FAILED:
            out = told("failed", response)
        elif time.time() - began > timeout:
            out = told("timeout")
        else:
            group.update((job, began))
            group.setTimeoutDuration(max(1, int(1000 * interval)))
            return
        if group.exists:
            group.remove()
        yield out

    keyed = requests.select(F.col("key").cast("string").alias("key"), F.col("payload").cast("string").alias("payload"))
    return keyed.groupBy("key").applyInPandasWithState(step, OUTCOME, "job string, began double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_jobs(spark: SparkSession, requests: DataFrame, folder: str, submit: Callable[[str], str | None], state: Callable[[str], tuple[str, str | None]], timeout: float = JOB_TIMEOUT, interval: float = JOB_INTERVAL) -> DataFrame:
    """The outcomes of a table of requests (key and payload; keys are unique): key, outcome, response.

    folder is shared by driver and executors. It keeps the requests, the state and the outcomes: a call with a folder that has them already
    goes on where the last one ended, with the requests that were written first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/requests/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        requests.select(F.col("key").cast("string").alias("key"), F.col("payload").cast("string").alias("payload")).write.mode("overwrite").parquet(f"{folder}/requests")
    stream = spark.readStream.schema("key string, payload string").parquet(f"{folder}/requests")
    out = job_outcomes(stream, submit, state, timeout, interval)
    query = out.writeStream.format("parquet").option("path", f"{folder}/outcomes").option("checkpointLocation", f"{folder}/state").trigger(processingTime=f"{max(1, int(1000 * min(interval, 1.0)))} milliseconds").start()
    try:
        while query.isActive:
            seen = query.lastProgress
            if seen and seen["stateOperators"] and not seen["stateOperators"][0]["numRowsTotal"]:
                break
            query.awaitTermination(0.2)
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
    return spark.read.schema(OUTCOME).parquet(f"{folder}/outcomes")
