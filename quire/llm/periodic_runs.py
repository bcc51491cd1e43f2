"""Maximal periodic runs of words, by the runs theorem.

Every run has, under one of the two orders of the words, a Lyndon root that is the longest Lyndon word at its place. The longest Lyndon
word at a place ends before the next smaller suffix under that order, so next-smaller values of the inverse suffix array give two
candidates per place, and a run is a candidate extended to both sides as far as its period holds. Extensions are longest common
prefixes of two suffixes: minima of the LCP array between them, from a sparse table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are what stands between these characters.
SPACES = r"[\x20\x09-\x0D]+"

#: A run has at least so many words, and so many times its period.
MIN_WORDS, MIN_PERIODS = 24, 3

#: Words whose texts are searched together; a longer text is searched alone.
BLOCK_WORDS = 1 << 19

RUN = T.StructType([T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False), T.StructField("period", T.LongType(), False)])


class Minima:
    """Least values of stretches of an array: a sparse table over powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each stretch begin:end, which must not be empty."""
        k = np.frexp((end - begin).astype(np.float64))[1] - 1
        out = np.empty(len(begin), self.levels[0].dtype)
        for level in np.unique(k).tolist():
            at = np.flatnonzero(k == level)
            table = self.levels[level]
            out[at] = np.minimum(table[begin[at]], table[end[at] - (1 << level)])
        return out


class Suffixes:
    """Sorted suffixes of several sequences of words, each compared within its own sequence.

    words: the sequences one after the other; lengths: how many words each has. Suffixes of later sequences come first, and a suffix
    that is a prefix of another one comes before it. Ranks of stretches of 1, 2, 4, ... words come from doubling; only suffixes that
    are not alone with their rank are sorted again."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray) -> None:
        n = len(words)
        which = np.repeat(np.arange(len(lengths))[::-1], lengths)
        self.ends = np.repeat(np.cumsum(lengths), lengths)
        key = which * (int(words.max(initial=0)) + 1) + words
        order = np.argsort(key, kind="stable")
        levels = [self._ranks(key[order], order)]
        width, open_ = 1, self._shared(levels[-1], order)
        while len(open_):
            rank = levels[-1].copy()
            follow = np.where(open_ + width < self.ends[open_], rank[np.minimum(open_ + width, n - 1)], -1).astype(np.int64)
            key = rank[open_].astype(np.int64) * (n + 1) + follow + 1
            by = np.argsort(key, kind="stable")
            members, key = open_[by], key[by]
            first = np.empty(len(by), bool)
            first[:1] = True
            first[1:] = key[1:] != key[:-1]
            group = np.flatnonzero(np.append(True, rank[members][1:] != rank[members][:-1]))
            begin = np.repeat(group, np.diff(np.append(group, len(by))))
            heads = np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
            rank[members] += (heads - begin).astype(rank.dtype)
            width *= 2
            levels.append(rank)
            alone = first & np.append(first[1:], True)
            open_ = members[~alone]
        self.rank = levels[-1]
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)
        self.common = Minima(self._neighbours(levels))

    @staticmethod
    def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Of each place, how many places have a smaller key."""
        rank = np.empty(len(order), np.int32)
        first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        return rank

    @staticmethod
    def _shared(rank: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The places that are not alone with their rank."""
        r = rank[order]
        same = np.zeros(len(r) + 1, bool)
        same[1:-1] = r[1:] == r[:-1]
        return order[same[1:] | same[:-1]]

    def _neighbours(self, levels: list[np.ndarray]) -> np.ndarray:
        """The LCP array: how many first words each sorted suffix has in common with the one before it, from the longest stretches of
        equal rank to the shortest."""
        n = len(self.order)
        common = np.zeros(n, np.int32)
        at = np.arange(1, n)
        for k in range(len(levels) - 2, -1, -1):
            rank, c = levels[k], common[at]
            a, b = self.order[at - 1] + c, self.order[at] + c
            inside = (a < self.ends[self.order[at - 1]]) & (b < self.ends[self.order[at]])
            equal = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            common[at[equal]] += 1 << k
        return common

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many first words the suffixes at a and b have in common; a differs from b."""
        x, y = self.rank[a].astype(np.int64), self.rank[b].astype(np.int64)
        return self.common.least(np.minimum(x, y) + 1, np.maximum(x, y) + 1).astype(np.int64)


def _lyndon_ends(rank: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the longest Lyndon word of each place ends, under the order of the ranks and under its reverse: at the next smaller and at the
    next greater rank of the same sequence, or at the sequence's end."""
    smaller, greater = ends.tolist(), ends.tolist()
    values, bounds = rank.tolist(), ends.tolist()
    low: list[int] = []
    high: list[int] = []
    bound = -1
    for i, v in enumerate(values):
        if bounds[i] != bound:
            bound, low, high = bounds[i], [], []
        while low and values[low[-1]] > v:
            smaller[low.pop()] = i
        low.append(i)
        while high and values[high[-1]] < v:
            greater[high.pop()] = i
        high.append(i)
    return np.array(smaller, np.int64), np.array(greater, np.int64)


def _extended(words: np.ndarray, lengths: np.ndarray, min_words: int, min_periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of every run of some sequences, by start and then period; places count through all sequences."""
    suffixes, n = Suffixes(words, lengths), len(words)
    ends = suffixes.ends
    starts = ends - np.repeat(lengths, lengths)
    places = np.arange(n)
    begin, end = np.tile(places, 2), np.concatenate(_lyndon_ends(suffixes.rank, ends))
    period = end - begin
    # the first root of a run begins within its first period, and this much of the run is left after it
    inside = (end < ends[begin]) & (ends[begin] - end > np.maximum(min_words, min_periods * period) - 2 * period)
    begin, end, period = begin[inside], end[inside], period[inside]
    ahead = suffixes.shared(begin, end) if len(begin) else begin
    rest = ahead > np.maximum(min_words, min_periods * period) - 2 * period
    begin, end, period, ahead = begin[rest], end[rest], period[rest], ahead[rest]
    if not len(begin):
        return begin, end, period
    # words before both, from the reversed sequences of the texts that still have candidates
    kept = np.unique(starts[begin])
    sizes = ends[kept] - kept
    offsets = np.cumsum(sizes) - sizes
    source = np.repeat(kept + sizes - 1 + offsets, sizes) - np.arange(int(sizes.sum()))
    backward = Suffixes(words[source], sizes)
    last = (lambda at: offsets[np.searchsorted(kept, starts[at])] + ends[at] - 1 - at)  # noqa: E731  where a place is in them
    has = begin > starts[begin]
    behind = np.zeros(len(begin), np.int64)
    if has.any():
        behind[has] = backward.shared(last(begin[has] - 1), last(end[has] - 1))
    first, stop = begin - behind, end + ahead
    long = stop - first >= np.maximum(min_words, min_periods * period)
    found = np.unique(np.stack([first[long], stop[long], period[long]], axis=1), axis=0)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found[:, 0], found[:, 1], found[:, 2]


def runs_of(words: np.ndarray, lengths: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[np.ndarray]:
    """For each sequence its runs: rows of start, length and smallest period, by start, then period.

    words: integers, equal where the words are; lengths: words of each sequence, which stand one after the other. min_periods is 2 or
    more."""
    if min_periods < 2:
        raise ValueError("the runs theorem holds from two periods on")
    first, stop, period = _extended(words, lengths, min_words, min_periods) if len(words) else (np.zeros(0, np.int64),) * 3
    bounds = np.cumsum(lengths)
    cuts = np.searchsorted(first, np.concatenate([[0], bounds]))
    origin = bounds - lengths
    return [np.stack([first[a:b] - o, (stop - first)[a:b], period[a:b]], axis=1) for a, b, o in zip(cuts[:-1], cuts[1:], origin)]


def repeated(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words a run contains after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth)[:n] > 0


def _words(texts: pa.Array) -> pa.ListArray:
    """The words of each text; of null none."""
    split = pc.split_pattern_regex(pc.utf8_trim(pc.fill_null(texts, ""), " \t\n\v\f\r"), SPACES)
    flat, parents = split.flatten(), pc.list_parent_indices(split)
    keep = pc.not_equal(flat, "")
    sizes = np.bincount(np.asarray(parents.filter(keep)), minlength=len(split))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), flat.filter(keep))


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and held + size > BLOCK_WORDS:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def word_runs(df: DataFrame, text: str = "text", tail: Column | None = None, period: Column | None = None, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """df with its text column replaced by n_words, runs (RUN; by start, then period) and collapsed: the text's words, joined by one
    space, without those that a run contains after its first period.

    tail and period, if given, replace each word from number ``tail`` on by word ``tail + (i - tail) % period`` first (planted
    repetitions); nulls plant nothing. A null or empty text has no words, no runs and an empty collapsed text. One row per row, equal
    rows alike; columns that have the names of the new ones are replaced. Texts are searched whole, in memory of n log n for the
    longest of them."""
    new = ["n_words", "runs", "collapsed"]
    rest = [c for c in df.columns if c != text and c not in new]
    rows = df.select(*rest, F.col(text).alias("__text"), (F.lit(None) if tail is None else tail).cast("bigint").alias("__tail"), (F.lit(None) if period is None else period).cast("bigint").alias("__period"))
    schema = T.StructType([rows.schema[c] for c in rest] + [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.field("element", pa.struct([pa.field(f.name, pa.int64(), False) for f in RUN.fields]), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(pc.fill_null(pc.utf8_length(batch.column(len(rest))), 0)) // 2 + 1
            for a, b in _blocks(lengths):
                yield done(batch.slice(a, b - a))

    def done(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = len(rest)
        lists = _words(batch.column(k))
        sizes, coded = np.diff(np.asarray(lists.offsets)).astype(np.int64), lists.values.dictionary_encode()
        ids, names = np.asarray(coded.indices).astype(np.int64), coded.dictionary
        begins = np.cumsum(sizes) - sizes
        for i, (t, p) in enumerate(zip(batch.column(k + 1).to_pylist(), batch.column(k + 2).to_pylist())):
            if t is not None and p is not None:
                own = ids[begins[i] : begins[i] + sizes[i]]
                own[t:] = own[t + np.arange(len(own) - t) % p]
        runs = runs_of(ids, sizes, min_words, min_periods)
        dropped = np.concatenate([repeated(r, n) for r, n in zip(runs, sizes.tolist())])
        left = np.append(0, np.cumsum(np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~dropped], minlength=len(sizes))))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), names.take(pa.array(ids[~dropped]))), " ")
        all_runs = np.concatenate(runs)
        offsets = pa.array(np.append(0, np.cumsum([len(r) for r in runs])), pa.int32())
        values = pa.StructArray.from_arrays([pa.array(all_runs[:, j]) for j in range(3)], fields=list(kind.value_type))
        columns = [*batch.columns[:k], pa.array(sizes), pa.ListArray.from_arrays(offsets, values, type=kind), texts]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs, where a tenth of the documents have a repetition planted by the rule of their id's CRC-32."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("bigint")
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), rf"\A{SPACES}|{SPACES}\z", "")
    n = F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACES))).cast("bigint")
    docs = docs.withColumn("n", F.when(h % 10 == 0, n)).withColumn("g", g).withColumn("tail", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    period = F.lit(1) + F.floor((F.col("n") - F.col("tail")) / (F.lit(3) + F.col("g") % 8))
    found = word_runs(docs.withColumn("period", period), tail=F.col("tail"), period=F.col("period"))
    r = F.col("runs")
    best = F.reduce(
        r, F.lit(None).cast(RUN),
        lambda a, x: F.when(a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"]), x).otherwise(a),
    )
    lines = F.array_join(F.transform(r, lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    b = F.col("best")
    return found.select(
        "doc_id", "n_runs", b["start"].alias("start"), b["length"].alias("length"), b["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
