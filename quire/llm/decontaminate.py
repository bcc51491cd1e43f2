"""Benchmark decontamination with a generalised suffix automaton of the benchmark items.

Items are normalised to words (A-Z lower-cased; runs of digits, letters and non-ASCII bytes). The automaton of all items tells, for
every word of a training text, the longest run of words up to there that occurs in some item. Words in runs of at least
``min_words`` are contaminated; an item shorter than that counts when it occurs whole.

Texts stream through in blocks. Words become numbers without a Python loop: byte classes by a table, word hashes from prefix sums,
vocabulary lookup by binary search. A run of two or more words needs every pair of neighbours to be neighbours in some item; so
the automaton only walks stretches where that holds and that are long enough. Every reported window is compared word by word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import settle

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Words of the items of one automaton. It is sent to the executors (about 400 bytes a word); a benchmark of more words is split into
#: several, one sent at a time, each taking a pass over the texts.
MAX_ITEM_WORDS = 500_000
#: Bytes of text that are numbered at a time. A longer text is a block of its own.
BLOCK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in lower-cased bytes."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], _IS_WORD[data], [False])).view(np.int8)))
    return edge[::2], edge[1::2]


_powers = np.ones((2, 1), np.uint64)


def _power(n: int) -> np.ndarray:
    """Rows BASE ** i and its inverse modulo 2 ** 64, for i below n at least."""
    global _powers
    if _powers.shape[1] < n:
        table = np.empty((2, max(BLOCK_BYTES + 1, n)), np.uint64)
        table[0], table[1] = BASE, pow(int(BASE), -1, 1 << 64)
        table[:, 0] = 1
        _powers = np.multiply.accumulate(table, axis=1)
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: prefix sums of byte * BASE ** place, moved back to place 0, and mixed with the length."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # a stretch of words at a time
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, side="right")))
        part = data[starts[i] : ends[j - 1]].astype(np.uint64)
        a, b = starts[i:j] - starts[i], ends[i:j] - starts[i]
        up, down = _power(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * up[: len(part)], out=sums[1:])
        h = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        h ^= h >> np.uint64(29)
        out[i:j] = h * np.uint64(0xBF58476D1CE4E5B9)
        i = j
    return out


def hash_words(words: Iterable[bytes]) -> np.ndarray:
    words = list(words)
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1 if words else np.empty(0, np.int64)
    starts = ends - [len(w) for w in words] if words else np.empty(0, np.int64)
    return word_hashes(data, np.asarray(starts, np.int64), np.asarray(ends, np.int64))


@dataclass
class Automaton:
    """A generalised suffix automaton over word numbers."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the words that end here by way of p; q keeps its longer ones."""
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def add(self, item: Iterable[int]) -> None:
        last = 0
        for w in item:
            known = self.next[last].get(w)
            if known is not None:  # an earlier item has this run
                last = known if self.length[known] == self.length[last] + 1 else self._split(last, w, known)
                continue
            cur = self._new(self.length[last] + 1, 0, {})
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
            last = cur

    def matches(self, words: Iterable[int]) -> Iterator[int]:
        """For each word the length of the longest run up to it that occurs in an item."""
        state = n = 0
        nxt, link, length = self.next, self.link, self.length
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                n += 1
            yield n


@dataclass
class Index:
    """What the executors need: vocabulary, neighbours, automaton, and the windows with their items."""

    hashes: np.ndarray  # sorted
    words: list[bytes]  # by number; numbers follow the order of hashes
    pairs: np.ndarray  # sorted numbers a * len(words) + b of neighbours
    automaton: Automaton
    windows: dict[tuple[int, ...], list[str]]  # ids of the items, or [] if the id is null
    lengths: list[int]  # of windows, ascending
    singles: np.ndarray  # numbers of words that are windows by themselves


def build_index(items: list[tuple[object, str | None]], window: int = WINDOW) -> Index:
    """items: (id, text). An item without words has no window."""
    texts = [(None if i is None else str(i), words_of(t)) for i, t in items]
    vocabulary = sorted({w for _, ws in texts for w in ws})
    hashes = hash_words(vocabulary)
    if len(np.unique(hashes)) != len(vocabulary):
        raise ValueError("two benchmark words share a hash")
    order = np.argsort(hashes)
    words = [vocabulary[i] for i in order]
    number = {w: i for i, w in enumerate(words)}
    automaton, windows, pairs = Automaton(), {}, set()
    for item, ws in texts:
        ids = [number[w] for w in ws]
        if not ids:
            continue
        automaton.add(ids)
        pairs.update(a * len(words) + b for a, b in zip(ids, ids[1:]))
        size = min(window, len(ids))
        for k in range(len(ids) - size + 1):
            owners = windows.setdefault(tuple(ids[k : k + size]), [])
            if item is not None and item not in owners:
                owners.append(item)
    lengths = sorted({len(w) for w in windows})
    singles = np.array(sorted(w[0] for w in windows if len(w) == 1), np.int64)
    return Index(hashes[order], words, np.array(sorted(pairs), np.int64), automaton, windows, lengths, singles)


def _find(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of values in sorted_, -1 where absent."""
    if not len(sorted_):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return np.where(sorted_[at] == values, at, -1)


@dataclass
class Hits:
    n_words: int
    spans: list[tuple[int, int]]  # merged, in words
    items: set[str]
    starts: np.ndarray  # byte places of the words
    ends: np.ndarray

    @property
    def n_hit(self) -> int:
        return sum(b - a for a, b in self.spans)


def scan_block(texts: list[bytes], index: Index) -> list[Hits]:
    """The windows of the index in each text. A zero byte keeps the texts apart."""
    data = _LOWER[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    starts, ends = word_spans(data)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(starts, bounds)
    found: list[list[tuple[int, int, list[str]]]] = [[] for _ in texts]
    if index.windows and len(starts):
        ids = _find(index.hashes, word_hashes(data, starts, ends))

        def verified(i: int, n: int) -> list[str] | None:
            key = tuple(ids[i : i + n].tolist())
            owners = index.windows.get(key)
            same = owners is not None and all(data[starts[i + k] : ends[i + k]].tobytes() == index.words[w] for k, w in enumerate(key))
            return owners if same else None

        def put(i: int, n: int, owners: list[str]) -> None:
            found[int(np.searchsorted(first, i, side="right")) - 1].append((i, i + n, owners))

        if len(index.singles):
            for i in np.flatnonzero(_find(index.singles, ids) >= 0).tolist():
                if (owners := verified(i, 1)) is not None:
                    put(i, 1, owners)
        longer = [n for n in index.lengths if n > 1]
        if longer:
            joined = (ids[:-1] >= 0) & (ids[1:] >= 0)
            at = np.flatnonzero(joined)
            joined[at] = _find(index.pairs, ids[at] * len(index.words) + ids[at + 1]) >= 0
            cut = first[1:-1]
            joined[cut[(cut > 0) & (cut <= len(joined))] - 1] = False  # not across texts
            edge = np.flatnonzero(np.diff(np.concatenate(([False], joined, [False])).view(np.int8)))
            a, b = edge[::2], edge[1::2] + 1  # stretches of words
            long = b - a >= longer[0]
            for i, j in zip(a[long].tolist(), b[long].tolist()):
                for k, m in enumerate(index.automaton.matches(ids[i:j].tolist())):
                    for n in longer:
                        if n > m:
                            break
                        if (owners := verified(i + k + 1 - n, n)) is not None:
                            put(i + k + 1 - n, n, owners)
    out = []
    for t, hits in enumerate(found):
        a, b = int(first[t]), int(first[t + 1])
        spans: list[tuple[int, int]] = []
        for i, j, _ in sorted(hits, key=lambda x: x[:2]):
            if spans and i - a <= spans[-1][1]:
                spans[-1] = spans[-1][0], max(spans[-1][1], j - a)
            else:
                spans.append((i - a, j - a))
        out.append(Hits(b - a, spans, {x for h in hits for x in h[2]}, starts[a:b] - bounds[t], ends[a:b] - bounds[t]))
    return out


def blocks(texts: Iterable[bytes], size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    n = 0
    for t in texts:
        if held and n + len(t) > size:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def without(text: bytes, hits: Hits, max_share: float) -> bytes | None:
    """The text without its contaminated spans; None if these hold more than max_share of its words."""
    if not hits.spans:
        return text
    if hits.n_hit > max_share * hits.n_words:
        return None
    out, at = [], 0
    for a, b in hits.spans:
        out.append(text[at : hits.starts[a]])
        at = int(hits.ends[b - 1])
    return b"".join([*out, text[at:]])


def item_groups(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", max_words: int = MAX_ITEM_WORDS) -> Iterator[list[tuple]]:
    """Items (id and text) whose texts have at most max_words words together, a larger item alone; fetched one partition at a time."""
    held: list[tuple] = []
    n = 0
    for r in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        size = len(words_of(r.t))
        if held and n + size > max_words:
            yield held
            held, n = [], 0
        held.append((r.i, r.t))
        n += size
    if held:
        yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_share: float = 0.5, doc_id: str = "doc_id", text: str = "text",
                  keep: tuple[str, ...] = (), max_words: int = MAX_ITEM_WORDS, want_text: bool = True) -> DataFrame:
    """One row per document: doc_id, the kept columns, n_words, n_hit, items (ids of the items with occurring windows, sorted as
    strings) and clean (the text without hit spans; null if over max_share of the words are hit, or if the text is null).

    Null and empty texts have no words and no hits. A null item id can hit but is in no list. Ties and repeated rows are judged
    alike. Without benchmark rows nothing is hit. One pass over the texts per automaton, no shuffle; a benchmark over max_words words
    has several: each is built, sent, and dropped once what it has found is settled, so that driver and executors hold one at a time.
    """
    groups = item_groups(benchmark, max_words=max_words)
    group = next(groups, [])
    rows = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(f"`{k}`") for k in keep], F.col(text).alias("__text"))
    for following in groups:
        sent = docs.sparkSession.sparkContext.broadcast(build_index(group, window))
        rows = settle(_one_pass(rows, sent, None, False))
        sent.destroy()
        group = following
    return _one_pass(rows, docs.sparkSession.sparkContext.broadcast(build_index(group, window)), max_share, want_text)


def _one_pass(rows: DataFrame, sent: Broadcast, max_share: float | None, want_text: bool) -> DataFrame:
    """rows with __text and, from earlier passes, __spans (merged, as a flat array of starts and ends) and __items. Returns them with
    what the sent index adds; with max_share, as the result of decontaminate()."""
    own = [c for c in rows.columns if c not in ("__text", "__spans", "__items")]
    schema = T.StructType([rows.schema[c] for c in own])
    if max_share is None:
        schema = schema.add("__text", T.StringType()).add("__spans", T.ArrayType(T.IntegerType())).add("__items", T.ArrayType(T.StringType()))
    else:
        schema = schema.add("n_words", T.LongType()).add("n_hit", T.LongType()).add("items", T.ArrayType(T.StringType())).add("clean", T.StringType())

    def cleaned(text: bytes, hits: Hits) -> str | None:
        left = without(text, hits, max_share)
        return None if left is None else left.decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text")
            before = zip(batch.column("__spans").to_pylist(), batch.column("__items").to_pylist()) if "__spans" in batch.schema.names else None
            columns = [batch.column(c) for c in own]
            valid = texts.is_valid().to_pylist()
            done = 0
            for block in blocks((t or "").encode() for t in texts.to_pylist()):
                hits = scan_block(block, sent.value)
                for h, (spans, items) in zip(hits, before or ()):
                    h.items |= set(items)
                    h.spans = merge(h.spans + list(zip(spans[::2], spans[1::2])))
                kept = [c.slice(done, len(block)) for c in columns]
                items = pa.array([sorted(h.items) for h in hits], pa.list_(pa.string()))
                if max_share is None:
                    added = [texts.slice(done, len(block)), pa.array([[x for s in h.spans for x in s] for h in hits], pa.list_(pa.int32())), items]
                else:
                    clean = [cleaned(t, h) if want_text and ok else None for t, h, ok in zip(block, hits, valid[done:])]
                    added = [pa.array([h.n_words for h in hits], pa.int64()), pa.array([h.n_hit for h in hits], pa.int64()), items, pa.array(clean, pa.string())]
                yield pa.RecordBatch.from_arrays([*kept, *added], schema.names)
                done += len(block)

    return rows.mapInArrow(run, schema)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def items_digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), want_text=False)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM iw, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
grams AS (
  SELECT rid, size, i, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM dw, sizes, unnest(range(1, len(w) - size + 2)) AS t(i) WHERE len(w) >= size),
hit AS (SELECT rid, i, grams.size, item_id FROM grams JOIN win ON grams.g = win.g AND grams.size = win.size),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, i, size FROM hit), unnest(range(i, i + size)) AS t(p) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
