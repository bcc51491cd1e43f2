"""Media columns: baseline JPEG files in a binary column, with dimensions and thumbnail hashes next to them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import jpeg

#: Bytes that are coded at a time and that a batch hands on.
CHUNK_BYTES = 1 << 20

FEATURES = T.StructType([
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("thumb_width", T.IntegerType()), T.StructField("thumb_height", T.IntegerType()),
    T.StructField("average_hash", T.StringType()), T.StructField("difference_hash", T.StringType()),
])


def _by_size(items: Iterable[bytes], size: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    n = 0
    for x in items:
        if held and n + len(x) > size:
            yield held
            held, n = [], 0
        held.append(x)
        n += len(x)
    if held:
        yield held


def padded(data: bytes) -> bytes:
    """data and zeros up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 if data else 64)


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: the text's UTF-8 bytes, padded, as the coefficients of a JPEG file. A null text is empty.

    One row per input row, repeated rows alike, in one pass; other columns are ignored."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, done = batch.column(0), 0
            for part in _by_size((t.as_py() or "").encode() for t in batch.column(1)):
                media = jpeg.encode_payloads([padded(p) for p in part])
                yield pa.RecordBatch.from_arrays([ids.slice(done, len(part)), pa.array([len(p) for p in part], pa.int64()), pa.array(media, pa.binary())], schema.names)
                done += len(part)

    return rows.mapInArrow(run, schema)


def media_features(df: DataFrame, media: str = "media", with_payload: bool = False) -> DataFrame:
    """df, a column ``features`` (FEATURES; null if the media value is null or no baseline file), ``features_error`` (why) and, on
    demand, ``payload``.

    Decodes the stored bytes: markers, Huffman codes, DC thumbnail, hashes. Files of a chunk are decoded together; if one is
    damaged, they are decoded one by one. A header whose image needs more codes than the file has bits is refused before anything
    is allocated for it. The media column itself is not repeated in the result."""
    at = df.columns.index(media)
    schema = df.drop(media).schema.add("features", FEATURES).add("features_error", T.StringType())
    if with_payload:
        schema = schema.add("payload", T.BinaryType())

    def decode(part: list[bytes]) -> list[tuple[dict | None, str | None, bytes | None]]:
        try:
            files = [(jpeg.parse(p), p) for p in part]
            coefficients = jpeg.decode(files)
            return [described(f, c) for (f, _), c in zip(files, coefficients)]
        except (jpeg.JpegError, IndexError) as e:  # an interval that runs past its end
            if len(part) > 1:
                return [x for p in part for x in decode([p])]
            return [(None, str(e), None)]

    def described(f: jpeg.File, c: np.ndarray) -> tuple[dict, None, bytes | None]:
        thumb = jpeg.thumbnail(f, c)
        a, d = jpeg.thumbnail_hashes(thumb)
        values = (f.width, f.height, thumb.shape[1], thumb.shape[0], f"{a:016x}", f"{d:016x}")
        return dict(zip(FEATURES.names, values)), None, jpeg.payload_of(f, c) if with_payload and any(x.startswith(jpeg.PAYLOAD) for x in f.comments) else None

    feature_type = pa.struct([(f.name, pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string()) for f in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            done = 0
            for part in _by_size(m.as_py() or b"" for m in batch.column(at)):
                found = decode(part)
                arrays = [pa.array([x[0] for x in found], feature_type), pa.array([x[1] for x in found], pa.string())]
                if with_payload:
                    arrays.append(pa.array([x[2] for x in found], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(c.slice(done, len(part)) for c in columns), *arrays], schema.names)
                done += len(part)

    return df.mapInArrow(run, schema)


def digests(payload: bytes) -> tuple[int, str, int]:
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    stored = stored.select("doc_id", "n_bytes", F.length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    read = media_features(stored, with_payload=True)
    f = F.col("features")
    tail = F.substring(F.col("payload"), -64, 64)
    return read.select(
        "doc_id", "n_bytes", F.length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256",
        F.concat_ws(":", f["width"], f["height"], f["average_hash"], f["difference_hash"]).alias("feature"),
    )
