"""Byte-level BPE by a rank file: a minimal perfect hash resolves pre-tokens that are tokens, a heap over linked bytes merges the rest."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Mean number of keys that share one displacement.
BUCKET = 4

#: Pre-tokens that either half of a worker's memory holds. A bound on memory, not on results.
REMEMBERED = 400_000

#: Bytes of text that one output batch holds at most, but for a single longer text.
BATCH_BYTES = 1 << 22

_MASK = 0xFFFFFFFFFFFFFFFF


def _mixed(h: int | np.ndarray, d: int | np.ndarray) -> int | np.ndarray:
    """A 64-bit hash and a displacement, mixed into 32 bits: on Python's integers or numpy's unsigned ones alike."""
    return ((((h ^ (d * 0x9E3779B97F4A7C15 & _MASK)) & _MASK) * 0xD6E8FEB86659FD93) & _MASK) >> 32


class PerfectHash:
    """A minimal perfect hash of distinct byte strings, by displacement: the n keys have the slots 0 to n - 1.

    A key's hash names its bucket; hash and the bucket's displacement, mixed, give the slot. Buckets are placed from the largest to the
    smallest; those of one key take whatever slots are left, which a negative displacement names. If some bucket finds no place, all
    begins again with another seed. Any other string has a slot, too: who asks compares the key that is kept there."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n, seed = len(keys), 0
        if len(set(keys)) != self.n:
            raise ValueError("the keys of a perfect hash are distinct")
        while not self._placed(keys, seed):
            seed += 1

    def _placed(self, keys: list[bytes], seed: int) -> bool:
        n, self.seed, self.buckets = self.n, seed, max(1, -(-self.n // BUCKET))
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for k in keys:
            h = xxhash.xxh64_intdigest(k, seed)
            groups[h % self.buckets].append(h)
        if any(len(set(g)) < len(g) for g in groups):
            return False
        free, self.displacements = np.ones(n, bool), [0] * self.buckets
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        for b in (b for b in order if len(groups[b]) > 1):
            hashes, start, width = np.array(groups[b], np.uint64)[:, None], 0, 32
            while True:
                slots = _mixed(hashes, np.arange(start, start + width, dtype=np.uint64)) % np.uint64(n)
                apart = np.sort(slots, axis=0)
                fits = free[slots].all(axis=0) & (apart[1:] != apart[:-1]).all(axis=0)
                if fits.any():
                    d = int(fits.argmax())
                    free[slots[:, d]] = False
                    self.displacements[b] = start + d
                    break
                start, width = start + width, min(1 << 14, width * 4)
                if start > 100 * n + 1000:
                    return False
        for b, slot in zip((b for b in order if len(groups[b]) == 1), np.flatnonzero(free).tolist()):
            self.displacements[b] = -1 - slot
        return True

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh64_intdigest(key, self.seed)
        d = self.displacements[h % self.buckets]
        return -1 - d if d < 0 else _mixed(h, d) % self.n


class ByteBpe:
    """The tokens of a rank file, their perfect hash, and the pairs of tokens that merge.

    Every single byte must be a token. Of all neighbours whose joined bytes are a token, those of the lowest rank merge first, the
    leftmost of these before others."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern, self.bytes_of = pattern, {i: t for t, i in ranks.items()}
        lacking = [b for b in range(256) if bytes([b]) not in ranks]
        if lacking:
            raise ValueError(f"no token of the single bytes {lacking}")
        self.hash = PerfectHash(list(ranks))
        self.at_slot: list[tuple[bytes, int] | None] = [None] * len(ranks)
        for t, i in ranks.items():
            self.at_slot[self.hash.slot(t)] = (t, i)
        self.of_byte = [ranks[bytes([b])] for b in range(256)]
        self.merges = {(ranks[t[:k]] << 32) | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}

    def whole(self, word: bytes) -> int | None:
        """The id of a pre-token that is a token."""
        found = self.at_slot[self.hash.slot(word)]
        return found[1] if found[0] == word else None

    def merged(self, word: bytes) -> list[int]:
        """The ids of a pre-token that is none: its bytes are a linked list, and a heap holds its neighbours' ranks.

        An entry of the heap is a rank and, in the low bits, a place; it is out of date if the pair at that place has another rank by now."""
        n, rank_of, push, pop = len(word), self.merges.get, heapq.heappush, heapq.heappop
        of_byte, shift = self.of_byte, n.bit_length()
        ids, low = [of_byte[b] for b in word], (1 << shift) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        due = [rank_of(a << 32 | b, -1) for a, b in zip(ids, ids[1:])]
        due.append(-1)
        heap = [r << shift | i for i, r in enumerate(due) if r >= 0]
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            rank, i = entry >> shift, entry & low
            if due[i] != rank:
                continue
            gone = after[i]
            j = after[i] = after[gone]
            ids[i], due[gone], due[i] = rank, -1, -1
            if j < n:
                before[j] = i
                r = rank_of(rank << 32 | ids[j])
                if r is not None:
                    due[i] = r
                    push(heap, r << shift | i)
            if i:
                j = before[i]
                r = rank_of(ids[j] << 32 | rank)
                if r is None:
                    due[j] = -1
                else:
                    due[j] = r
                    push(heap, r << shift | j)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out


class Encoder(dict):
    """Of a pre-token, its ids as little-endian unsigned 32-bit integers. Remembers them: when as many as ``most`` (REMEMBERED) are held,
    these become the older half, of which those that are met again stay."""

    def __init__(self, bpe: ByteBpe, most: int | None = None) -> None:
        self.bpe, self.split, self.older, self.most = bpe, regex.compile(bpe.pattern).findall, {}, most or REMEMBERED

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            data = word.encode()
            i = self.bpe.whole(data)
            ids = np.array(self.bpe.merged(data) if i is None else [i], "<u4").tobytes()
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))


_encoders: dict[str, Encoder] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: lines of a base64 token, a blank and its rank. At most as many as a vocabulary has."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines()) if token}


def _shared(spark: SparkSession, path: str, pattern: str) -> tuple[str, Broadcast]:
    """The vocabulary, read and hashed on the driver, once for all executors: its size is that of the file."""
    bpe = ByteBpe(read_ranks(path), pattern)
    key = hashlib.sha256(Path(path).read_bytes() + pattern.encode()).hexdigest()
    return key, spark.sparkContext.broadcast(bpe)


def _encoder(key: str, shared: Broadcast) -> Encoder:
    if key not in _encoders:
        _encoders[key] = Encoder(shared.value)
    return _encoders[key]


def _mapped(df: DataFrame, column: str, out: str, work: Callable[[], Callable]) -> DataFrame:
    """df with the column replaced by binary values that work gives for each of its values."""
    at = df.columns.index(column)
    schema = T.StructType([f for i, f in enumerate(df.schema.fields) if i != at]).add(out, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = work()
        for batch in batches:
            rest, values = [c for i, c in enumerate(batch.columns) if i != at], batch.column(at)
            done, held, size = 0, [], 0
            for k in range(len(values)):
                held.append(do(values[k].as_py()))
                size += len(held[-1])
                if size >= BATCH_BYTES or k + 1 == len(values):
                    yield pa.RecordBatch.from_arrays([*(c.slice(done, len(held)) for c in rest), pa.array(held, pa.binary())], schema.names)
                    done, held, size = k + 1, [], 0

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with its text column replaced by the text's ids: little-endian unsigned 32-bit integers in one binary value.

    Each match of the pattern is encoded separately; strings of special tokens are text like any other. A null text is an empty one,
    and an empty text has no ids. Equal rows are encoded alike, other columns stay as they are. A text is encoded whole, in time
    n log n of its longest pre-token."""
    key, shared = _shared(df.sparkSession, path, pattern)

    def work():
        encoder = _encoder(key, shared)
        return lambda t: encoder.encode(t or "")

    return _mapped(df, text, ids, work)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """df with its ids column (as encode makes it) replaced by the bytes of these tokens. Null is no ids. An id that no token has
    fails the job: it comes from another vocabulary."""
    key, shared = _shared(df.sparkSession, path, pattern)

    def work():
        bytes_of = _encoder(key, shared).bpe.bytes_of
        return lambda v: b"".join(map(bytes_of.__getitem__, np.frombuffer(v or b"", "<u4").tolist()))

    return _mapped(df, ids, data, work)


def unpacked(ids: bytes) -> list[int]:
    """The ids of a packed value."""
    return np.frombuffer(bytes(ids), "<u4").tolist()


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path, pattern)
    kept = encoded.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode(kept, path, pattern).select("doc_id", "n_tokens", "ids_sha256", F.sha2("data", 256).alias("decoded_sha256"))
