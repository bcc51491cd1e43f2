"""Sharding by sampled splitters.

1. Keys: a hash of the text, then one of the id, then one of the row's number, so that groups of equal texts, and of rows equal in both,
   can be divided too. Numbers are given once and kept in the shared checkpoint folder, so that all later passes see the same.
2. A size-weighted sample of the keys gives splitters at its quantiles; records are range-partitioned by them.
3. Ranges that hold more than their share are subdivided at the quantiles of their own keys until none is overfull.
4. Within its range every record has an exact running size, so shard boundaries fall on exact fractions of all bytes, and running
   numbers give every record its slot in the shard.

Only thin rows (id, size, checksum, key) are shuffled, once; the texts are not, unless they are kept columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.lineage import shared_folder
from quire.llm.common import settle, unit_hash

SHARDS = 16
#: Ranges per shard at least, bytes of a range beyond that, sampled keys per range, and the size (in mean ranges) over which a range is
#: overfull and divided. Splitters and counts of ranges are on the driver: at 100 TB about 400,000.
RANGES_PER_SHARD, RANGE_BYTES, KEYS_PER_RANGE, OVERFULL = 16, 256 << 20, 16, 2.0


def utf8(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, __k1, __k2, __k3 and kept columns: a record's key is (k1, k2, k3), k1 from the text alone, k2 from the id,
    k3 from the row's number. Those numbers may differ when this is computed again: it is stored before it is used."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("bigint").alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
        F.xxhash64(t).alias("__k1"), F.xxhash64(F.col(doc_id), F.lit("id")).alias("__k2"),
        F.xxhash64(F.monotonically_increasing_id(), F.lit("row")).alias("__k3"), *[F.col(f"`{c}`") for c in keep],
    )


KEY = ("__k1", "__k2", "__k3")


def _join_key(*parts: np.ndarray) -> np.ndarray:
    """Keys as 24-byte strings that sort like (k1, k2, k3)."""
    out = np.empty((len(parts[0]), len(parts)), ">u8")
    for i, k in enumerate(parts):
        out[:, i] = k.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out.view(f"S{8 * len(parts)}").ravel()


def sample(keys: DataFrame, total: int, count: int, where: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """About count keys, drawn with probability in proportion to size, in order, with weights. The hash decides, so a rerun draws
    the same; the expected number is bounded by count whatever the input."""
    rate = F.col("size") * (count / max(total, 1))
    rows = keys if where is None else keys.filter(where)
    drawn = rows.filter(unit_hash(*map(F.col, KEY), F.lit("sample")) < rate)
    got = drawn.groupBy(*KEY).agg(F.sum(F.greatest(F.col("size").cast("double"), F.lit(total / count))).alias("w")).toPandas()
    k = _join_key(*(got[c].to_numpy() for c in KEY))
    order = np.argsort(k)
    return k[order], got.w.to_numpy(dtype=float)[order]


def quantiles(keys: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    """Keys at the parts - 1 inner quantiles, distinct."""
    if not len(keys) or parts < 2:
        return keys[:0]
    cum = np.cumsum(weights)
    at = np.searchsorted(cum, cum[-1] * np.arange(1, parts) / parts, side="left")
    return np.unique(keys[np.minimum(at, len(keys) - 1)])


def ranged(keys: DataFrame, splitters: np.ndarray) -> DataFrame:
    """keys and rng: the number of splitters at or below the key."""

    @F.pandas_udf("int")
    def place(k1: pd.Series, k2: pd.Series, k3: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, _join_key(k1.to_numpy(), k2.to_numpy(), k3.to_numpy()), side="right").astype(np.int32))

    return keys.withColumn("__rng", place(*KEY))


def find_splitters(keys: DataFrame, shards: int = SHARDS) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """Splitters whose ranges are not overfull, and rows and bytes by range. One record larger than a range stays whole:
    a range that no sampled key divides any more is left."""
    first = keys.agg(F.sum("size").alias("s"), F.max("size").alias("m")).first()
    total, largest = int(first.s or 0), int(first.m or 0)
    parts = max(shards * RANGES_PER_SHARD, total // RANGE_BYTES)
    splitters = quantiles(*sample(keys, total, parts * KEYS_PER_RANGE), parts)
    mean = total / parts
    while True:
        counts = ranged(keys, splitters).groupBy("__rng").agg(F.count("*").alias("n"), F.sum("size").alias("s")).collect()
        sizes = {r["__rng"]: (r.n, int(r.s)) for r in counts}
        full = sorted(i for i, (n, s) in sizes.items() if n > 1 and s > OVERFULL * mean + largest)
        if not full:
            return splitters, sizes
        inner = ranged(keys, splitters)
        more = [splitters]
        in_full = sum(sizes[i][1] for i in full)
        k, w = sample(inner, in_full, len(full) * 4 * KEYS_PER_RANGE + int(in_full / mean) * KEYS_PER_RANGE, F.col("__rng").isin(full))
        owner = np.searchsorted(splitters, k, side="right")
        for i in full:
            more.append(quantiles(k[owner == i], w[owner == i], int(sizes[i][1] / mean) + 1))
        more = np.unique(np.concatenate(more))
        if len(more) == len(splitters):
            return splitters, sizes
        splitters = more


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, kept columns, shard and slot, one row per input row. Shards have equal bytes up to one record; slots
    count from 0 in each shard.

    Null texts have size 1; null ids and repeated rows are records like others; a text that many rows share is divided by id, and
    rows that also share the id by their numbers. Columns of docs that are not kept are ignored. Fewer
    records than shards leave shards empty; an empty table gives no rows. keep names none of the result's own columns. Kept columns are written to the shared checkpoint
    folder with the keys, so that each pass reads only its columns, and shuffled along, once.
    """
    rows = keyed(docs, doc_id, text, keep)
    if keep:
        folder = shared_folder(docs.sparkSession, "shard-keys")
        rows.write.parquet(folder)
        keys = docs.sparkSession.read.parquet(folder)
    else:
        keys = settle(rows)
    splitters, sizes = find_splitters(keys, shards)
    if not sizes:
        return rows.drop(*KEY).select("*", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    total = sum(s for _, s in sizes.values())
    ranges = range(max(sizes) + 1)
    offset = list(accumulate((sizes.get(r, (0, 0))[1] for r in ranges), initial=0))

    def literal(values: Sequence[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    def placed(rows: DataFrame) -> DataFrame:
        """Before and within the range: the exact bytes in front of each record. Its middle decides the shard."""
        order = Window.partitionBy("__rng").orderBy(*KEY)
        rows = ranged(rows, splitters)
        before = F.get(literal(offset), F.col("__rng")) + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        middle = (before * 2 + F.col("size")).cast("decimal(38,0)") * shards
        return rows.select("*", F.row_number().over(order).alias("__k"), F.least(F.lit(shards - 1), F.floor(middle / (2 * total)).cast("int")).alias("shard"))

    # A shard's part of a range is contiguous: slots need, for each part, its first number and the records of the shard before it.
    thin = settle(placed(keys).select("doc_id", "size", "text_crc32", "__rng", "__k", "shard"))
    parts = sorted((r["__rng"], r.shard, r.n, r.k) for r in thin.groupBy("__rng", "shard").agg(F.count("*").alias("n"), F.min("__k").alias("k")).collect())
    seen: dict[int, int] = {}
    start: dict[tuple[int, int], int] = {}
    low: dict[int, int] = {}
    for rng, s, n, k in parts:
        start[rng, s] = seen.get(s, 0) - k
        seen[s] = seen.get(s, 0) + n
        low[rng] = min(s, low.get(rng, s))
    width = max(s - low[rng] for rng, s in start) + 1
    flat = literal([start.get((rng, low.get(rng, 0) + j), 0) for rng in ranges for j in range(width)])
    at = F.col("__rng") * width + F.col("shard") - F.get(literal([low.get(rng, 0) for rng in ranges]), F.col("__rng")).cast("int")
    rows = placed(keys) if keep else thin
    return rows.select("doc_id", "size", "text_crc32", *[F.col(f"`{c}`") for c in keep], "shard", (F.col("__k") + F.get(flat, at)).cast("bigint").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the documents as one folder per shard, ordered by slot within its files."""
    columns = [c for c in docs.columns if c not in (doc_id, "shard", "slot", "size", "text_crc32")]
    rows = shard_by_bytes(docs, shards, doc_id, text, keep=columns).withColumnRenamed("doc_id", doc_id)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
