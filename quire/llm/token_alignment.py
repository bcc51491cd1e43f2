"""Alignment of two tokenizers' tokens: minimal groups by union-find over overlapping tokens, and corpus-wide counts of linked ids.

A document's tokens of both tokenizers are the two sides of a graph whose edges are overlaps of byte ranges. Its connected components
are the minimal groups: stretches of both token sequences with the same bytes that no shared token end divides further. Components
expand into links of two tokens, links are counted by their two ids over the corpus, and the counts go back to the documents.

Counts travel by blocks of documents: a block lists its distinct id pairs once, most frequent first, and a document refers to places in
that list. So no pair, however common, has more rows than there are blocks, and no table of pairs goes through the driver.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.byte_bpe import ByteBpe, Encoder
from quire.llm.common import settle

#: Bytes of text that one block holds, and that are compared at a time; a longer text is alone.
BLOCK_BYTES, PART_BYTES = 1 << 23, 1 << 20

#: Pre-tokens that either half of a worker's memory holds.
WORDS = 700_000

#: Which of a component's pairs of tokens are links: those that end together, or all that overlap.
LINKS = ("end", "overlap")

_MARK = "▁"
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: bytes that are visible in Latin-1 stand for themselves, the others
    are the code points from 256 on, in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_byte_level(path: str) -> dict[bytes, int]:
    """Tokens and ids of a byte-level BPE file of the tokenizers library, without special tokens. Its merges must have their results' order."""
    model, alphabet = json.loads(Path(path).read_text())["model"], byte_alphabet()
    vocab = model["vocab"]
    results = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(b <= a for a, b in zip(results, results[1:])):
        raise ValueError("the merges are not in the order of their tokens")
    plain = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if all(c in alphabet for c in t)}
    return {t: i for t, i in plain.items() if len(t) == 1 or i >= results[0]}


class Pieces:
    """The piece model: the pieces' bytes, and the ids of texts."""

    def __init__(self, model: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace(_MARK, " ").encode() for p in pieces]

    def encode(self, text: str) -> bytes | None:
        """The packed ids of a text, or None if the pieces' bytes are not those of a space and the text."""
        ids = self.model.encode(text, num_threads=1)
        return np.array(ids, "<u4").tobytes() if b"".join(map(self.bytes_of.__getitem__, ids)) == b" " + text.encode() else None


class Sides:
    """Both tokenizers, and of each id its number of bytes and its decimal digits with what may follow it in a description of groups."""

    def __init__(self, bpe: ByteBpe, pieces: bytes) -> None:
        self.a, self.b = Encoder(bpe, WORDS), Pieces(pieces)
        size = max(bpe.bytes_of) + 1
        self.a_bytes = np.array([len(bpe.bytes_of.get(i, b"")) for i in range(size)], np.int64)
        self.b_bytes = np.array([len(x) for x in self.b.bytes_of], np.int64)
        self.a_size, b_size = size, len(self.b.bytes_of)
        self.digits = [b"%d%s" % (i, end) for end in (b",", b"|") for i in range(size)] + [b"%d%s" % (i, end) for end in (b",", b";") for i in range(b_size)]


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest vertex of each vertex's connected component: union-find on all edges u-v at once. Roots of an edge's two sides are
    joined, the larger to the smaller, then every path is compressed, until no edge joins two roots."""
    parent = np.arange(n)
    while True:
        pu, pv = parent[u], parent[v]
        apart = pu != pv
        if not apart.any():
            return parent
        u, v, pu, pv = u[apart], v[apart], pu[apart], pv[apart]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above


def align(a_ends: np.ndarray, b_ends: np.ndarray, links: str = "end") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of two divisions of the same bytes, given the byte offsets where their tokens end.

    Returns the group number of each token of either side, counted from 0, and the links as two arrays of token numbers, in order."""
    if links not in LINKS:
        raise ValueError(f"links are one of {LINKS}")
    cuts = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")  # two sorted stretches: merged, not sorted anew
    cuts = cuts[np.append(cuts[1:] != cuts[:-1], True)[: len(cuts)]]  # between two cuts lies one token of each side: an edge
    a, b = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
    root = components(len(a_ends) + len(b_ends), a, b + len(a_ends))
    a_group, b_group = root[: len(a_ends)], root[len(a_ends) :]  # the smallest member is always one of the first side
    number = np.cumsum(np.append(np.ones(min(1, len(a_group)), np.int64), a_group[1:] != a_group[:-1])) - 1
    of_b = number[b_group]
    member = slice(None) if links == "overlap" else a_ends[a] == b_ends[b]
    return number, of_b, a[member], b[member]


def _planes(values: np.ndarray) -> bytes:
    """Non-negative integers below 2^32 as their number of bytes, then all lowest bytes, all second ones, and so on."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    return sum((planes[i].astype(np.int64) << (8 * i) for i in range(width)), np.zeros(planes.shape[1], np.int64))


_ROW = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()), T.StructField("n_links", T.LongType()),
    T.StructField("groups_sha256", T.StringType()), T.StructField("groups", T.StringType()), T.StructField("__steps", T.BinaryType()), T.StructField("__times", T.BinaryType()),
    T.StructField("__pairs", T.ArrayType(T.LongType())), T.StructField("__counts", T.ArrayType(T.LongType())),
])
_NONE = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "groups": "", "__steps": _planes(np.zeros(0, np.int64)), "__times": _planes(np.zeros(0, np.int64))}


def _part(sides: Sides, packed: list[tuple[bytes, bytes]], links: str, with_groups: bool) -> tuple[list[dict], list[np.ndarray]]:
    """Rows of several documents, and each one's links as packed pairs of ids."""
    a_sizes, b_sizes = (np.array([len(p[k]) // 4 for p in packed]) for k in (0, 1))
    a, b = (np.frombuffer(b"".join(p[k] for p in packed), "<u4").astype(np.int64) for k in (0, 1))
    a_ends, b_ends = np.cumsum(sides.a_bytes[a]), np.cumsum(sides.b_bytes[b])
    a_group, b_group, la, lb = align(a_ends, b_ends, links)  # every document's end is an end of both sides
    n_groups = int(a_group[-1]) + 1
    # tokens in the order of groups, the first side's before the second's
    a_in, b_in = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
    a_before, b_before = np.cumsum(a_in), np.cumsum(b_in)
    codes = np.empty(len(a) + len(b), np.int64)
    a_last, b_last = a_before[a_group] - 1 == np.arange(len(a)), b_before[b_group] - 1 == np.arange(len(b))
    codes[np.arange(len(a)) + (b_before - b_in)[a_group]] = a + a_last * sides.a_size
    codes[np.arange(len(b)) + a_before[b_group]] = 2 * sides.a_size + b + b_last * len(sides.b_bytes)
    pairs = (a[la] << 32) | b[lb]
    a_stop, b_stop = np.cumsum(a_sizes), np.cumsum(b_sizes)
    link_stop = np.searchsorted(la, a_stop)
    rows, own = [], []
    token, link, group = 0, 0, 0
    for i in range(len(packed)):
        stop, groups_stop = int(a_stop[i] + b_stop[i]), int(a_group[a_stop[i] - 1]) + 1
        text = b"".join(map(sides.digits.__getitem__, codes[token:stop].tolist()))[:-1]
        rows.append({"n_a": int(a_sizes[i]), "n_b": int(b_sizes[i]), "n_groups": groups_stop - group, "n_links": int(link_stop[i]) - link, "groups_sha256": hashlib.sha256(text).hexdigest(), "groups": text.decode() if with_groups else None})
        own.append(pairs[link : link_stop[i]])
        token, link, group = stop, int(link_stop[i]), groups_stop
    return rows, own


def _block(rows: list[dict], own: list[np.ndarray]) -> dict:
    """Gives the documents of a block their places in the block's list of pairs, and returns that list with its counts."""
    inverse, pairs = pd.factorize(np.concatenate(own))  # by hash, in the order of occurrence
    counts = np.bincount(inverse, minlength=len(pairs))
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    places, begin = place[inverse], 0
    for row, keys in zip(rows, own):
        at, times = np.unique(places[begin : begin + len(keys)], return_counts=True)
        row["__steps"], row["__times"] = _planes(np.diff(at, prepend=0)), _planes(times)
        begin += len(keys)
    return {"__pairs": pairs[order], "__counts": counts[order]}


def _aligned(docs: DataFrame, text: str, make: Callable[[], Sides], links: str, with_groups: bool) -> DataFrame:
    """A row for each document, and one for each block with the block's pairs."""
    rest = [c for c in docs.columns if c != text]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in rest] + _ROW.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, number = make(), TaskContext.get().partitionId() << 33
        kept: list[pa.Array] = []
        rows: list[dict] = []
        found: list[tuple[int, np.ndarray]] = []  # row number and links
        waiting: list[tuple[int, bytes, bytes]] = []
        size = held = 0
        types = None

        def compare() -> None:
            nonlocal held
            if waiting:
                new, own = _part(sides, [w[1:] for w in waiting], links, with_groups)
                for (i, *_), row, keys in zip(waiting, new, own):
                    rows[i] = row
                    found.append((i, keys))
            waiting.clear()
            held = 0

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            compare()
            listed = _block([rows[i] for i, _ in found], [k for _, k in found]) if found else {"__pairs": [], "__counts": []}
            arrays = [pa.concat_arrays([k[j] for k in kept]) for j in range(len(rest))]
            arrays += [pa.array([number] * len(rows), types["block"])] + [pa.array([r.get(f) for r in rows], types[f]) for f in _ROW.names[1:]]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)
            if found:
                last = {"block": [number], **{k: [v] for k, v in listed.items()}}
                yield pa.RecordBatch.from_arrays([pa.nulls(1, a.type) for a in arrays[: len(rest)]] + [pa.array(last.get(f, [None]), types[f]) for f in _ROW.names], schema.names)
            number, size = number + 1, 0
            kept.clear(), rows.clear(), found.clear()

        for batch in batches:
            types = types or {f: t for f, t in zip(_ROW.names, [pa.int64()] * 5 + [pa.string()] * 2 + [pa.binary()] * 2 + [pa.list_(pa.int64())] * 2)}
            at, begin = batch.schema.get_field_index(text), 0
            columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            for k, value in enumerate(batch.column(at)):
                t = value.as_py()
                b = sides.b.encode(t) if t else None
                rows.append(_NONE)
                if b is not None:
                    waiting.append((len(rows) - 1, sides.a.encode(" " + t), b))
                    size, held = size + len(t), held + len(t)
                if held >= PART_BYTES:
                    compare()
                if size >= BLOCK_BYTES:
                    kept.append([c.slice(begin, k + 1 - begin) for c in columns])
                    begin = k + 1
                    yield from block()
            kept.append([c.slice(begin) for c in columns])
        if rows:
            yield from block()

    return docs.mapInArrow(run, schema)


def _counted(parts: DataFrame) -> DataFrame:
    """Of each block's pairs, in the block's order, the corpus-wide count and whether it is the highest of the second id."""
    listed = parts.where(F.col("__pairs").isNotNull())
    places = listed.select("block", F.posexplode(F.arrays_zip("__pairs", "__counts")).alias("place", "p")).select("block", "place", F.col("p.__pairs").alias("pair"), F.col("p.__counts").alias("n"))
    counts = places.groupBy("pair").agg(F.sum("n").alias("count"))
    second = F.col("pair").bitwiseAND(0xFFFFFFFF)  # ids of one vocabulary: at most as many rows as the other vocabulary has
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(second)))
    return places.select("block", "place", "pair").join(counts, "pair").select("block", "place", "count", "best")


def pair_counts(parts: DataFrame) -> DataFrame:
    """id_a, id_b and count: how many links of the corpus have these two ids. parts is what aligned() keeps."""
    p = parts.where(F.col("__pairs").isNotNull()).select(F.explode(F.arrays_zip("__pairs", "__counts")).alias("p"))
    counts = p.groupBy(F.col("p.__pairs").alias("pair")).agg(F.sum("p.__counts").alias("count"))
    return counts.select(F.shiftright("pair", 32).cast("int").alias("id_a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("id_b"), "count")


def aligned(docs: DataFrame, byte_level: str, pieces: str, pattern: str, text: str = "text", links: str = "end", with_groups: bool = False) -> DataFrame:
    """The settled parts that link_scores() and pair_counts() read: docs without its text column, with n_a, n_b, n_groups, n_links,
    groups_sha256 and, on demand, groups (`a1,a2|b1;a3|b2,b3`), and one row per block with that block's pairs.

    byte_level and pieces are paths on the driver; the files are sent to the executors once. Both tokenizers encode a space and then
    the text. A text that is null or empty, or whose tokens' bytes are not these bytes, has no tokens: zeros and ''."""
    spark = docs.sparkSession
    names = {f.name.lower() for f in _ROW.fields}
    docs = docs.select(*[c for c in docs.columns if c == text or c.lower() not in names])
    shared = spark.sparkContext.broadcast((ByteBpe(read_byte_level(byte_level), pattern), Path(pieces).read_bytes()))
    key = hashlib.sha256(Path(byte_level).read_bytes() + Path(pieces).read_bytes() + pattern.encode()).hexdigest()

    def make() -> Sides:
        if key not in _sides:
            _sides[key] = Sides(*shared.value)
        return _sides[key]

    return settle(_aligned(docs, text, make, links, with_groups))


_sides: dict[str, Sides] = {}


def link_scores(parts: DataFrame) -> DataFrame:
    """The documents of aligned() with n_best, the number of their links whose count is the highest that their second id has in the
    corpus (ties included), and count_sum, the sum of their links' counts."""
    docs = parts.where(F.col("__pairs").isNull()).withColumn("__block", F.col("block")).drop("block", "__pairs", "__counts")
    schema = T.StructType([f for f in docs.schema.fields if f.name not in ("__block", "__steps", "__times")] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def score(own: pa.Table, listed: pa.Table) -> pa.Table:
        count, best = np.zeros(listed.num_rows, np.int64), np.zeros(listed.num_rows, np.int64)
        place = np.asarray(listed["place"])
        count[place], best[place] = np.asarray(listed["count"]), np.asarray(listed["best"]).astype(np.int64)
        n_best, total = [], []
        for steps, times in zip(own["__steps"], own["__times"]):
            at, n = np.cumsum(_unplaned(steps.as_py())), _unplaned(times.as_py())
            n_best.append(int((best[at] * n).sum()))
            total.append(int((count[at] * n).sum()))
        return own.select([f.name for f in schema.fields[:-2]]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))

    return docs.groupBy("__block").cogroup(_counted(parts).groupBy("block")).applyInArrow(score, schema)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    parts = aligned(docs, public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"), public.PATTERN)
    return link_scores(parts).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
