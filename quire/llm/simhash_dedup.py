"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 8 bytes. Two fingerprints that differ in at most d = 2 bits differ in at most 2 bytes, so they share at least
8 - d = 6 positional bytes. The index lists fingerprints under combinations of positional bytes: the 8 positions form 4 groups
of 2, at most 2 groups can differ, so such a pair meets under at least one of the 6 pairs of groups. For every pair that meets,
the shared positional bytes are tallied from the two values (a tally of postings of single bytes would give the same number; such
postings would hold 1/256 of the corpus each); pairs below the guaranteed minimum go, the rest are verified by their differing bits.

Postings longer than MAX_POSTING are not paired: their fingerprints are linked through all values one bit away in the unshared
bytes (two fingerprints differ in at most 2 bits if and only if some value is at most one bit from either). That is linear in the
posting and loses no link's connection. Equal fingerprints are one node, so copies are never paired. Components are found by
alternating large-star and small-star steps on the links.

SimHash within 2 bits finds close copies only: of 48 pairs of sf0.1 with a Jaccard similarity of 0.8 or more over five-word shingles, 1
is within 2 bits, and no guaranteed number of shared bytes holds at the 11 bits that would be needed. So keep_one(), which the
pipeline uses, also links texts of that similarity; see quire.llm.similar_texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import settle
from quire.llm.components import components
from quire.llm.similar_texts import BAND_FIELDS, band_arrays, by_block, similar_links, text_sets

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Postings up to this length are paired.
MAX_POSTING = 64
#: Shingles hashed at a time, so that long texts need no more memory than short ones.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    return fingerprint_of((text or "").encode(), shingle)


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes: lower-cases A-Z, splits at \x20 and \x09-\x0D
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    totals = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        spans = zip(starts[a:b].tolist(), ends[a + size - 1 : b + size - 1].tolist())
        h = np.fromiter((digest(joined[i:j], SEED) for i, j in spans), np.uint64, b - a)
        totals += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * totals > n).tolist()))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit number) and the kept expressions."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), *[F.expr(k) for k in keep], F.col(text).alias("__text"))
    schema = rows.drop("__text").withColumn("fp", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(at)), np.uint64, batch.num_rows).view(np.int64)
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fps, pa.int64())], [f.name for f in schema])

    return rows.mapInArrow(run, schema)


def _bytes(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]


#: Pairs of 2-byte groups: what the index lists fingerprints under.
COMBOS = list(combinations(range(4), 2))


def _mask(groups: tuple[int, ...]) -> int:
    m = sum(0xFFFF << (16 * g) for g in groups)
    return m - (1 << 64) if m >> 63 else m


def links(nodes: DataFrame, max_posting: int = MAX_POSTING) -> DataFrame:
    """nodes: distinct fp. Returns links a, b (a < b) between fingerprints; their connected components are those of all pairs
    with at most 2 differing bits."""
    entry = [F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("key")) for i, g in enumerate(COMBOS)]
    index = nodes.select("fp", F.explode(F.array(*entry)).alias("e")).select("fp", "e.c", "e.key")
    sizes = index.groupBy("c", "key").agg(F.count("*").alias("n")).filter("n > 1")
    posting = settle(index.join(sizes, ["c", "key"]))
    short = posting.filter(F.col("n") <= max_posting)
    left, right = short.select("c", "key", F.col("fp").alias("a")), short.select("c", "key", F.col("fp").alias("b"))
    pairs = left.join(right, ["c", "key"]).filter("a < b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    shared = sum(((x == 0).cast("int") for x in _bytes(differ)), F.lit(0))
    near = pairs.filter(shared >= 8 - MAX_BITS).filter(F.bit_count(differ) <= MAX_BITS).select("a", "b")
    # Long postings: every value within one bit in the unshared bytes is a meeting point.
    flips = []
    for i, g in enumerate(COMBOS):
        bits = [b for k in range(4) if k not in g for b in range(16 * k, 16 * k + 16)]
        flips.append(F.when(F.col("c") == i, F.array(F.lit(0).cast("bigint"), *[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("bigint") for b in bits])))
    long = posting.filter(F.col("n") > max_posting)
    meet = long.select("fp", F.explode(F.coalesce(*flips)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    hub = meet.groupBy("at").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z").select("at", "a")
    star = meet.join(hub, "at").filter("a < fp").select("a", F.col("fp").alias("b"))
    return near.unionByName(star).distinct()


def linked(prints: DataFrame) -> DataFrame:
    """prints: fp, and a column ``first`` that orders rows. Returns fp, root and component_first (the smallest of the component,
    nulls last), one row per distinct fingerprint."""
    nodes = settle(prints.groupBy("fp").agg(F.min("first").alias("first")))
    comp = settle(components(links(nodes.select("fp"))))
    rooted = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    tops = rooted.groupBy("root").agg(F.min("first").alias("component_first"))
    return rooted.select("fp", "root").join(tops, "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp, component_id (the smallest doc_id that links reach).

    Null texts are empty and have fingerprint 0, linked like any other. Null doc_ids take part but are no component_id unless a
    component has no other. Repeated rows are equal nodes. Other columns are ignored; an empty table gives no rows.
    """
    prints = settle(fingerprints(docs, doc_id, text))
    groups = linked(prints.select("fp", F.col("doc_id").alias("first")))
    return prints.join(groups.select("fp", F.col("component_first").alias("component_id")), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near-duplicates: of each component the row of smallest doc_id (nulls last; ties: smallest text hash) stays, with
    all its columns. Of rows that share doc_id and text one stays, the one whose columns have the smallest hash.

    Components are those of one graph over the distinct texts: its links are fingerprints within MAX_BITS, and similarities of
    similar_texts.SIMILARITY or more. Texts are known by 128 bits of hashes. Texts are shuffled twice: those with candidates, to be
    compared, and all, to be kept."""
    hashes = F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text))
    names = ("__h", "__g")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).isNull().alias("no_id"), *[x.alias(n) for x, n in zip(hashes, names)], F.col(text).alias("__text"))
    prints = settle(_prints_and_bands(rows))
    # One row per distinct text, with a number of its own. It is settled, so that the numbers stay.
    texts = prints.groupBy(*names).agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("n").alias("n"), F.min(F.struct("no_id", "doc_id")).alias("f"))
    texts = settle(texts.select(F.monotonically_increasing_id().alias("h"), *names, "fp", "bands", "n", "f.*"))
    groups = settle(texts.groupBy("fp").agg(F.min("h").alias("first")))
    same = texts.join(groups, "fp").filter("h <> first").select(F.col("first").alias("a"), F.col("h").alias("b"))
    near = links(groups.select("fp"))
    near = near.join(groups.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(groups.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")

    def sets_of(wanted: DataFrame) -> DataFrame:
        chosen = texts.join(wanted, "h").select("h", "root", *[F.col(n).alias(f"{n}t") for n in names], F.col("doc_id").alias("__id"))
        met = rows["doc_id"].eqNullSafe(chosen["__id"]) & (rows["__h"] == chosen["__ht"]) & (rows["__g"] == chosen["__gt"])
        return text_sets(rows.join(chosen, met).select("h", "root", "__text"))

    edges = similar_links(texts.select("h", "bands", "n"), sets_of).unionByName(same).unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    comp = components(edges)
    linked_rows = settle(comp.join(texts.select(F.col("h").alias("node"), "no_id", "doc_id", *names), "node"))
    firsts = linked_rows.groupBy("root").agg(F.min(F.struct("no_id", "doc_id", *names, "node")).alias("first"))
    losers = linked_rows.join(firsts, "root").filter(F.col("node") != F.col("first.node")).select(F.col("node").alias("h"))
    chosen = settle(texts.join(losers, "h", "left_anti").select(F.col("doc_id").alias("__id"), *names))
    stay = docs.join(chosen, docs[doc_id].eqNullSafe(chosen["__id"]) & (hashes[0] == chosen["__h"]) & (hashes[1] == chosen["__g"]), "left_semi")
    repeated = prints.groupBy("doc_id", *names).agg(F.count("*").alias("m")).filter("m > 1").limit(1).count()
    if not repeated:
        return stay
    columns = [F.col(f"`{c}`") for c in docs.columns]
    least = F.min_by(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]), F.xxhash64(*columns)).alias("r")
    one = stay.groupBy(F.col(doc_id).alias("__id"), hashes[0].alias("__h"), hashes[1].alias("__g")).agg(least)
    return one.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _prints_and_bands(rows: DataFrame) -> DataFrame:
    """rows with a column __text: their other columns, fp, bands and n, in one pass over the texts."""
    added = [T.StructField("fp", T.LongType()), *BAND_FIELDS]
    prints = lambda block: pa.array(np.fromiter(map(fingerprint_of, block), np.uint64, len(block)).view(np.int64), pa.int64())
    return by_block(rows, added, lambda block: [prints(block), *band_arrays(block)])


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
