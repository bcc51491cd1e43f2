"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Terms are hashed byte trigrams of the text, byte pairs of its words' shapes, and coarse marks of repetition and layout. A truncated SVD of
the weighted term matrix of a bounded labelled sample gives the latent space; the sample's unit vectors and labels are broadcast.
Every document is projected, exact cosines with all labelled vectors come from blocked matrix products, and the labels of the
nearest neighbours vote with weights that grow with similarity; the rarer label's votes are lifted to balance, and all labelled vectors
together have a small share, which orders documents whose neighbours agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms of each kind; latent dimensions, labelled vectors (the documented bound of the sample), neighbours, sharpness of the vote
#: and the share of the vote that all labelled vectors have together. Chosen by splits of the learnable rows.
TRIGRAMS, SHAPES, MARKS = 1536, 256, 64
TERMS = TRIGRAMS + SHAPES + MARKS
DIMENSIONS, FIT_ROWS, NEIGHBOURS, SHARPNESS, EVERYONE = 32, 3000, 9, 6.0, 0.1
THRESHOLD = 0.3
#: Bytes of text whose terms are counted at a time.
BLOCK_BYTES = 1 << 20

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t\r\n\x0b\x0c")] = 1
_CLASS[ord("\n")] = 2
_CLASS[ord("a") : ord("z") + 1] = 3
_CLASS[ord("A") : ord("Z") + 1] = 4
_CLASS[ord("0") : ord("9") + 1] = 5
_CLASS[128:] = 6
for _i, _c in enumerate(b".,;:!?|#%&$*-_/\\\"'()[]{}<>=+@~"):
    _CLASS[_c] = 7 + _i % 9


def _mixed(x: np.ndarray, size: int) -> np.ndarray:
    return ((x * np.uint32(2654435761)) >> np.uint32(12)) % np.uint32(size)


def _bin(x: np.ndarray, edges: tuple[float, ...]) -> np.ndarray:
    return np.searchsorted(np.asarray(edges), x, side="right")


def count_terms(texts: list[bytes], block_bytes: int = BLOCK_BYTES) -> np.ndarray:
    """Term counts, one row per text. Texts are counted whole, a block at a time; the size of the blocks changes nothing."""
    out = np.zeros((len(texts), TERMS), np.float32)
    words = np.zeros((len(texts), 4))  # words, distinct-word estimate, lines, bytes
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= block_bytes):
            n += len(texts[j])
            j += 1
        if len(texts[i]) > block_bytes:
            _count_long(texts[i], out[i], words[i], block_bytes)
        else:
            _count_block(texts[i:j], out[i:j], words[i:j])
        i = j
    base = TRIGRAMS + SHAPES
    total = np.maximum(words[:, 0], 1)
    marks = [
        _bin(words[:, 1] / total, (0.15, 0.3, 0.45, 0.6, 0.75, 0.9)),
        8 + _bin(total, (4, 8, 16, 32, 64, 128, 256)),
        16 + _bin(words[:, 3] / total, (3, 4, 5, 6, 7, 9, 12)),
        24 + _bin(words[:, 2] / total, (0.01, 0.03, 0.06, 0.12, 0.25, 0.5)),
    ]
    size = np.maximum(out[:, :TRIGRAMS].sum(axis=1), 1)
    for m in marks:
        out[np.arange(len(texts)), base + m] = np.maximum(1, size / 40)
    return out


def _terms(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The trigram and shape terms that start at the first n bytes; two more bytes follow."""
    d, c = data.astype(np.uint32), _CLASS[data].astype(np.uint32)
    tri = _mixed((d[:n] << np.uint32(16)) | (d[1 : n + 1] << np.uint32(8)) | d[2 : n + 2], TRIGRAMS)
    return tri, TRIGRAMS + _mixed((c[:n] << np.uint32(8)) | (c[1 : n + 1] << np.uint32(4)) | c[2 : n + 2], SHAPES)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words that end before the data's end."""
    n = len(data)
    blank = (_CLASS[data] <= 2) & (_CLASS[data] > 0)
    end = np.flatnonzero(blank & ~np.concatenate(([True], blank[:-1])))
    start = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))[: len(end)]
    d = data.astype(np.uint64)
    sums, plain = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    np.cumsum(d * (np.arange(n, dtype=np.uint64) + np.uint64(7)), out=sums[1:])
    np.cumsum(d, out=plain[1:])
    s = plain[end] - plain[start]
    return start, (sums[end] - sums[start]) - s * start.astype(np.uint64) + (s << np.uint64(32)) + (end - start).astype(np.uint64) * np.uint64(1 << 50)


def _count_long(text: bytes, out: np.ndarray, words: np.ndarray, block_bytes: int) -> None:
    """Counts one text in stretches that end after a blank, so that no word is divided; trigrams look two bytes beyond."""
    data = np.frombuffer(text + b"\n\n\n", np.uint8)
    stop, a = len(text) + 1, 0
    distinct = np.empty(0, np.uint64)
    while a < stop:
        b = a + block_bytes
        while b < stop:  # to the next blank; the line ends are one
            part = _CLASS[data[b - 1 : b - 1 + block_bytes]]
            at = np.flatnonzero((part > 0) & (part <= 2))
            b += int(at[0]) if len(at) else len(part)
            if len(at):
                break
        b = min(b, stop)
        for term in _terms(data[a : b + 2], b - a):
            out += np.bincount(term, minlength=TERMS).astype(np.float32)
        start, h = _word_hashes(data[a:b])
        words[0] += len(start)
        distinct = np.union1d(distinct, h)
        words[2] += np.count_nonzero(data[a:b] == 10)
        a = b
    words[1] += len(distinct)
    words[3] += len(text)


def _count_block(texts: list[bytes], out: np.ndarray, words: np.ndarray) -> None:
    # Three line ends after each text: no trigram that counts reaches into the next text.
    data = np.frombuffer(b"".join(t + b"\n\n\n" for t in texts), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts])
    own = np.ones(len(data), bool)
    stop = np.cumsum(lengths + 2)
    own[stop - 1] = own[stop - 2] = False
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), lengths + 2)
    n = len(owner) - 2
    own, owner = own[:n], owner[:n]
    rows = len(texts)
    for term in _terms(data, n):
        out += np.bincount((owner * TERMS + term)[own], minlength=rows * TERMS).reshape(rows, TERMS).astype(np.float32)
    # Words and how many of them repeat, by a small hash.
    start, h = _word_hashes(data[:n])
    if len(start):
        of = owner[start]
        order = np.lexsort((h, of))
        ho, oo = h[order], of[order]
        fresh = np.concatenate(([True], (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])))
        words[:, 0] += np.bincount(of, minlength=rows)
        words[:, 1] += np.bincount(oo[fresh], minlength=rows)
    words[:, 2] += np.bincount(owner[own & (data[:n] == 10)], minlength=rows)
    words[:, 3] += lengths - 1


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    idf: np.ndarray
    projection: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # unit vectors of the labelled documents
    labels: np.ndarray

    def __post_init__(self) -> None:
        ones, zeros = (self.labels == 1).sum(), (self.labels == 0).sum()
        self.lift = np.where(self.labels == 0, ones / zeros, 1.0) if ones and zeros else np.ones(len(self.labels))

    def project(self, counts: np.ndarray) -> np.ndarray:
        z = weighted(counts, self.idf) @ self.projection
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, block: int = 512) -> np.ndarray:
        out = np.empty(len(counts))
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(counts), block):
            cosine = self.project(counts[a : a + block]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            w = np.exp(SHARPNESS * (cosine - cosine.max(axis=1, keepdims=True)).astype(np.float64)) * self.lift
            whole = (w @ self.labels) / w.sum(axis=1)
            w = np.take_along_axis(w, near, axis=1)
            out[a : a + block] = (1 - EVERYONE) * (w * self.labels[near]).sum(axis=1) / w.sum(axis=1) + EVERYONE * whole
        return np.clip(out, 0, 1)


def _counted(docs: DataFrame, text: str = "__text") -> DataFrame:
    """Replaces the text by its term counts (float32 bytes)."""
    at = docs.columns.index(text)
    schema = docs.drop(text).schema.add("counts", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                counts = count_terms([(t or "").encode() for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns) if i != at), pa.array([c.tobytes() for c in counts], pa.binary())], schema.names)

    return docs.mapInArrow(run, schema)


def learnable(doc_id: Column) -> Column:
    """Rows whose label may be learnt: the checksum of the id as text is no multiple of 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, seed: int = 7) -> Model:
    """Learns from at most fit_rows labelled documents (those of smallest id hash among the rows that may be learnt).

    Rows with null ids, null labels or without a document are left out. Without any the model scores every text 0.5. An id counts
    once: of several labels the lesser, of several documents the least text; so at most fit_rows rows reach the driver, however often
    rows repeat. A hot id is reduced before its rows meet.
    """
    chosen = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("label"))
    chosen = chosen.filter(F.col("__id").isNotNull() & F.col("label").isin(0, 1) & learnable(F.col("__id"))).groupBy("__id").agg(F.min("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id")
    rows = rows.groupBy("__id", "label").agg(F.min("__text").alias("__text"))
    got = sorted(((r["__id"], r["label"], bytes(r["counts"])) for r in _counted(rows).collect()))
    if not got:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.ones((1, 1), np.float32), np.array([0.5]))
    counts = np.frombuffer(b"".join(c for _, _, c in got), np.float32).reshape(len(got), TERMS)
    y = np.array([label for _, label, _ in got], float)
    idf = (np.log((1 + len(got)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = weighted(counts, idf)
    # Randomised truncated SVD.
    k = min(DIMENSIONS, len(got), TERMS)
    q = x.T @ np.random.default_rng(seed).standard_normal((len(got), k + 16)).astype(np.float32)
    for _ in range(4):
        q, _r = np.linalg.qr(q)
        q = x.T @ (x @ q)
    q, _r = np.linalg.qr(q)
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    projection = (q @ vt.T)[:, :k].astype(np.float32)
    z = x @ projection
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    return Model(idf, projection, z.astype(np.float32), y)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs and a score: 0 to 1, higher where the label 1 is likelier. Null and empty texts are scored like any text without terms."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                s = sent.value.score(count_terms([(t or "").encode() for t in part.column(at).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
