"""Links between texts of a Jaccard similarity of 0.8 or more over five-word shingles, for the pipeline's near-duplicate stage.

The scheme is that of the SimHash index, over bands of min-hashes instead of bytes: an inverted index with count filtering, then
verification. A pair is a candidate if it shares at least SHARED bands, and linked if its exact similarity is high enough.

1. The index lists texts by band. Short postings give pairs, which are counted; texts that share two long postings are joined to the
   first of each. Only ids move.
2. The components of these candidates are clusters. A cluster within the bounds is compared in one task, to which each of its texts'
   shingles are sent once. So what is shuffled does not grow with the pairs.
3. Clusters beyond the bounds are not cut: short postings are verified by joins, long ones by pivots and then by blocks.

Results are forests of links: their components are those of all linked pairs, however they were compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import settle
from quire.llm.components import components
from quire.llm.decontaminate import blocks, word_hashes

#: Words of a shingle, least similarity, bands of min-hashes and their rows, and bands that a pair must share. A pair at the least
#: similarity shares so many bands with probability 0.997.
SHINGLE, SIMILARITY, BANDS, ROWS, SHARED = 5, 0.8, 16, 4, 2
#: Postings up to this length give their pairs one by one.
MAX_POSTING = 64
#: A cluster is compared in one task if that takes so many steps at most (texts times shingles and bands of all, about ten seconds) and it
#: has so many shingles at most (64 MB).
MAX_WORK, MAX_SHINGLES = 1 << 32, 1 << 23
#: In clusters beyond that: postings up to this length are compared within one task, also the texts of a block of longer ones; and texts
#: that are compared with all others of such a posting before the blocks are.
MAX_WHOLE, PIVOTS = 256, 2

_ODD = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS + SHINGLE + ROWS, dtype=np.uint64) | np.uint64(1)
_MINS, _WORDS, _KEYS = np.split(_ODD, [BANDS * ROWS, BANDS * ROWS + SHINGLE])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> np.uint64(31))


def shingle_block(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles of SHINGLE words, repeats included, and where each text's begin (one place more than texts). Words
    are runs without blanks, A-Z lower-cased; a text of fewer words is one shingle, one without words has none."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ~_BLANK[data], [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    at = np.concatenate(([0], np.cumsum(count)))
    w = _mixed(word_hashes(data, starts, ends)) if len(starts) else np.empty(0, np.uint64)
    begin = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    size = np.repeat(np.minimum(n, SHINGLE), count)
    h = np.zeros(at[-1], np.uint64)
    for k in range(SHINGLE):
        on = size > k
        h[on] += w[begin[on] + k] * _WORDS[k]
    h = _mixed(h) * _WORDS[0]
    return h ^ (h >> np.uint64(29)), at


def band_block(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of BANDS signed keys per text; texts without shingles have zeros."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, BANDS), np.uint64)
    if len(full):
        mixed, begin = _mixed(hashes), at[full]
        mins = np.stack([np.minimum.reduceat(mixed * m, begin) for m in _MINS], axis=1).reshape(len(full), BANDS, ROWS)
        keys = (_mixed(mins) * _KEYS).sum(axis=2, dtype=np.uint64)
        out[full] = keys ^ (keys >> np.uint64(29))
    return out.view(np.int64)


def shingle_hashes(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(shingle_block([(text or "").encode()])[0])


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int64()))


def by_block(rows: DataFrame, added: list[T.StructField], of: Callable[[list[bytes]], list[pa.Array]]) -> DataFrame:
    """Replaces the column __text by the added columns, which are made a block of texts at a time."""
    own = [c for c in rows.columns if c != "__text"]
    schema = T.StructType([*(rows.schema[c] for c in own), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for block in blocks((t.as_py() or "").encode() for t in batch.column("__text")):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(done, len(block)) for c in own), *of(block)], schema.names)
                done += len(block)

    return rows.mapInArrow(run, schema)


BAND_FIELDS = [T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("n", T.LongType())]


def band_arrays(texts: list[bytes]) -> list[pa.Array]:
    """The columns BAND_FIELDS: the bands of each text (none without words), and the number of its shingles."""
    hashes, at = shingle_block(texts)
    n = np.diff(at)
    return [_lists(band_block(hashes, at)[n > 0].ravel(), np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0))))), pa.array(n, pa.int64())]


def text_bands(rows: DataFrame) -> DataFrame:
    """rows with a column __text: their other columns, bands and n."""
    return by_block(rows, BAND_FIELDS, band_arrays)


def text_sets(rows: DataFrame) -> DataFrame:
    """rows with a column __text: their other columns and s, the distinct hashes of the shingles."""
    def sets(texts: list[bytes]) -> list[pa.Array]:
        hashes, at = shingle_block(texts)
        found = [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:])]
        return [_lists(np.concatenate(found).view(np.int64), np.concatenate(([0], np.cumsum(list(map(len, found))))))]

    return by_block(rows, [T.StructField("s", T.ArrayType(T.LongType()))], sets)


def forest(h: np.ndarray, sets: list[np.ndarray], fits: Callable[[int], np.ndarray], lab: np.ndarray, heads: np.ndarray, similarity: float, whole: bool = False) -> list[tuple[int, int]]:
    """Links between texts of different lab. fits(i): which texts i may be linked with. Only heads are compared with the others. If not
    whole, linked labs become one, so that the links are a forest."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    present = np.zeros(int(ids.max()) + 1, bool)
    out: list[tuple[int, int]] = []
    for i in heads:
        fit = fits(i) & (lab != lab[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]))
        if not fit.any():
            continue
        own = ids[starts[i] : starts[i] + sizes[i]]
        present[own] = True
        common = np.add.reduceat(present[ids], starts, dtype=np.int64)
        present[own] = False
        for j in np.flatnonzero(fit & (common >= similarity * (sizes + sizes[i] - common))):
            if lab[i] != lab[j]:
                out.append((min(h[i], h[j]), max(h[i], h[j])))
                if not whole:
                    lab[lab == lab[j]] = lab[i]
    return out


def _cluster_links(h: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """All links within one cluster, as a forest. A text that came more than once counts once."""
    h, one = np.unique(h, return_index=True)
    if len(h) < 2:
        return []
    sets = [sets[i] for i in one]
    keys = band_block(np.concatenate(sets).view(np.uint64), np.concatenate(([0], np.cumsum(list(map(len, sets))))))

    def fits(i: int) -> np.ndarray:
        out = (keys == keys[i]).sum(axis=1) >= SHARED
        out[: i + 1] = False
        return out

    return forest(h, sets, fits, np.arange(len(h)), np.arange(len(h) - 1), similarity)


def clustered_links(rows: DataFrame, similarity: float) -> DataFrame:
    """rows: root, h, s, where the rows of a root are few enough for one task. The links a < b within each root.

    Roots are dealt out by hash and read in order, so a task has many roots and holds one at a time. They are dealt by a hash column of
    their own: a partitioning by root that a join below has made would do, but it may be given up when that join is planned anew."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, h, sets = None, [], []
        done: list[tuple[int, int]] = []
        for batch in batches:
            roots = batch.column("root").to_numpy(zero_copy_only=False)
            ids = batch.column("h").to_numpy(zero_copy_only=False)
            lists = batch.column("s")
            values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i in range(batch.num_rows):
                if roots[i] != root:
                    done += _cluster_links(np.array(h, np.int64), sets, similarity)
                    root, h, sets = roots[i], [], []
                h.append(ids[i])
                sets.append(values[at[i] : at[i + 1]].copy())
            yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in done], pa.int64()) for k in (0, 1)], ["a", "b"])
            done = []
        done = _cluster_links(np.array(h, np.int64), sets, similarity)
        yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in done], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = rows.select("root", "h", "s", F.xxhash64("root", F.lit("task")).alias("task")).repartition("task")
    return dealt.sortWithinPartitions("root").mapInArrow(run, "a bigint, b bigint")


def similar_links(bands: DataFrame, sets_of: Callable[[DataFrame], DataFrame], max_posting: int = MAX_POSTING, similarity: float = SIMILARITY,
                  max_work: int = MAX_WORK, max_whole: int = MAX_WHOLE) -> DataFrame:
    """bands: h (one row per text), bands and n. sets_of: from rows with distinct h to them and s (a row may come more than once).

    Links a < b between texts of at least the similarity; their components are those of all such pairs that share SHARED bands,
    whatever the lengths of the postings and the sizes of the clusters."""
    index = bands.filter(F.size("bands") > 0).select("h", F.posexplode("bands").alias("c", "key"))
    sizes = index.groupBy("c", "key").agg(F.count("*").alias("m")).filter("m > 1")
    posting = settle(index.join(sizes, ["c", "key"]))
    long = posting.filter(F.col("m") > max_posting)
    own = F.array_sort(F.collect_list(F.struct("c", "key")))
    long = settle(long.groupBy("h").agg(own.alias("o"), F.sum("m").alias("mates")).select("h", "mates", F.col("o.c").alias("cs"), F.col("o.key").alias("ks")))
    any_long = bool(long.limit(1).count())
    pairs = settle(_short_pairs(posting.filter(F.col("m") <= max_posting).select("h", "c", "key"), long if any_long else None))
    # A text with one long posting shares at most one with any other: its pairs have met in short ones, or have too few.
    long = long.filter(F.size("cs") >= SHARED)
    candidates = pairs
    if any_long:
        entries = long.select("h", F.explode(F.arrays_zip("cs", "ks")).alias("e")).select("h", "e.*")
        heads = entries.groupBy("cs", "ks").agg(F.min("h").alias("a"))
        candidates = pairs.unionByName(entries.join(heads, ["cs", "ks"]).filter("a < h").select("a", F.col("h").alias("b")))
    clusters = settle(components(candidates).select(F.col("node").alias("h"), "root").join(bands.select("h", "n"), "h"))
    totals = clusters.groupBy("root").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    work = F.col("texts").cast("double") * (F.col("shingles") + BANDS * F.col("texts"))
    large = settle(totals.filter((work > max_work) | (F.col("shingles") > MAX_SHINGLES)).select("root"))
    if not large.limit(1).count():
        return clustered_links(sets_of(clusters.select("h", "root")), similarity)
    sets = settle(sets_of(clusters.select("h", "root")))
    small = clustered_links(sets.join(large, "root", "left_anti"), similarity)
    sets = sets.join(large, "root", "left_semi").select("h", "s").dropDuplicates(["h"])
    hs = clusters.join(large, "root", "left_semi").select("h")
    left = _large_links(pairs.join(hs, pairs["a"] == hs["h"], "left_semi"), long.join(hs, "h", "left_semi"), sets, similarity, max_whole)
    return small.unionByName(left)


def _short_pairs(short: DataFrame, long: DataFrame | None) -> DataFrame:
    """a < b that share SHARED postings, those of the texts' long ones included."""
    shared = F.lit(0)
    if long is not None:
        short = short.join(long.select("h", F.arrays_zip("cs", "ks").alias("o")), "h", "left")
        shared = F.when(F.col("oa").isNull() | F.col("ob").isNull(), F.lit(0)).otherwise(F.size(F.array_intersect("oa", "ob")))
    side = lambda x: short.select("c", "key", *[F.col(k).alias(v) for k, v in {"h": x, "o": f"o{x}"}.items() if k in short.columns])
    met = side("a").join(side("b"), ["c", "key"]).filter("a < b").select("a", "b", shared.alias("m"))
    return met.groupBy("a", "b").agg((F.count("*") + F.first("m")).alias("n")).filter(F.col("n") >= SHARED).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("h").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b")


def _compared(tasks: DataFrame, similarity: float) -> DataFrame:
    """tasks: task, h, lab, s, cs and ks (the text's long postings), c, side and whole. Links between the texts of one task (side 0), or
    of its side 1 with its side 2, each under the first of the pair's common long postings only."""
    def near(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h")
        h, lab, side = (rows[x].to_numpy(copy=True) for x in ("h", "lab", "side"))
        c, whole = int(rows.c.iloc[0]), bool(rows.whole.iloc[0])
        keys, has = np.zeros((len(h), BANDS), np.int64), np.zeros((len(h), BANDS), bool)
        for i, (cs, ks) in enumerate(zip(rows.cs, rows.ks)):
            keys[i, cs], has[i, cs] = ks, True
        right = side != 1

        def fits(i: int) -> np.ndarray:
            same = (keys == keys[i]) & has & has[i]
            out = right & same[:, c] & ~same[:, :c].any(axis=1) & (same.sum(axis=1) >= SHARED)
            if side[i] == 0:
                out[: i + 1] = False
            return out

        return pd.DataFrame(forest(h, list(rows.s), fits, lab, np.flatnonzero(side != 2), similarity, whole), columns=["a", "b"], dtype="int64")

    return tasks.groupBy("task").applyInPandas(near, "a bigint, b bigint")


def _large_links(pairs: DataFrame, long: DataFrame, sets: DataFrame, similarity: float, max_whole: int) -> DataFrame:
    """The links of clusters that are too large for one task. pairs: candidates of short postings. long: h, mates, cs and ks.

    Long postings up to max_whole are compared within one task each. In those beyond, the texts that have most band mates are compared
    with all others, and what is in different components then is compared pair by pair, in blocks; a posting of one component is
    finished."""
    sets = settle(sets)
    parts = ["h", "lab", "cs", "ks", "c", "key"]
    entries = settle(long.select("*", F.explode(F.arrays_zip("cs", "ks")).alias("e")).select("h", "mates", "cs", "ks", F.col("e.cs").alias("c"), F.col("e.ks").alias("key")))
    lengths = entries.groupBy("c", "key").agg(F.count("*").alias("n")).filter("n > 1")
    middle = entries.join(lengths.filter(F.col("n") <= max_whole).select("c", "key"), ["c", "key"]).withColumn("lab", F.col("h"))
    middle = middle.select(*parts).join(sets, "h").withColumns({"side": F.lit(0), "whole": F.lit(True), "task": F.struct("c", "key")})
    edges = settle(_verified(pairs, sets, similarity).unionByName(_compared(middle, similarity)).distinct())
    huge = entries.join(lengths.filter(F.col("n") > max_whole).select("c", "key"), ["c", "key"])
    if not huge.limit(1).count():
        return edges
    huge = settle(huge)

    def unfinished() -> DataFrame:
        """The entries of the huge postings that have several components, with the component as lab."""
        comp = components(edges).select(F.col("node").alias("h"), F.col("root").alias("lab"))
        rows = huge.join(comp, "h", "left").withColumn("lab", F.coalesce("lab", "h"))
        several = rows.groupBy("c", "key").agg(F.min("lab").alias("x"), F.max("lab").alias("y")).filter("x < y").select("c", "key")
        return settle(rows.join(several, ["c", "key"]))

    rows = unfinished()
    used = None
    for _ in range(PIVOTS):
        if not rows.limit(1).count():
            return edges
        free = rows.groupBy("c", "key", "lab").agg(F.max(F.struct("mates", "h")).alias("top"))
        if used is not None:  # not the component of an earlier pivot
            free = free.join(rows.join(used, ["c", "key", "h"]).select("c", "key", "lab"), ["c", "key", "lab"], "left_anti")
        pivots = settle(free.groupBy("c", "key").agg(F.max(F.struct("top", "lab")).alias("p")).select("c", "key", F.col("p.top.h").alias("p"), F.col("p.lab").alias("plab")))
        star = rows.join(pivots, ["c", "key"]).filter("lab <> plab").select(F.least("h", "p").alias("a"), F.greatest("h", "p").alias("b")).distinct()
        edges = settle(edges.unionByName(_verified(star, sets, similarity)).distinct())
        chosen = pivots.select("c", "key", F.col("p").alias("h"))
        used = chosen if used is None else used.unionByName(chosen)
        rows = unfinished()
    if not rows.limit(1).count():
        return edges
    # What is left: blocks of large components and blocks of all others. Two blocks of one component need no comparison.
    counts = rows.groupBy("c", "key", "lab").agg(F.count("*").alias("m"))
    pool = counts.filter(F.col("m") < max_whole).groupBy("c", "key").agg(F.sum("m").alias("pool"))
    big = F.col("m") >= max_whole
    blocked = rows.join(counts, ["c", "key", "lab"]).join(pool, ["c", "key"], "left")
    number: Column = F.pmod(F.xxhash64("h", F.lit("block")), F.ceil(F.when(big, F.col("m")).otherwise(F.col("pool")) / max_whole))
    blocked = blocked.withColumn("one", F.when(big, F.col("lab"))).withColumn("blk", F.xxhash64("one", number))
    blocked = settle(blocked.select(*parts, "one", "blk"))
    places = blocked.select("c", "key", "one", "blk").distinct()
    other = places.select("c", "key", F.col("one").alias("one2"), F.col("blk").alias("blk2"))
    tasks = places.join(other, ["c", "key"]).filter("blk <= blk2 AND NOT coalesce(one = one2, false)").select("c", "key", "blk", "blk2")
    sides = F.when(F.col("blk") == F.col("blk2"), F.array(F.struct(F.col("blk").alias("at"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("blk").alias("at"), F.lit(1).alias("side")), F.struct(F.col("blk2").alias("at"), F.lit(2).alias("side"))))
    tasks = tasks.select("c", "key", F.struct("c", "key", "blk", "blk2").alias("task"), F.explode(sides).alias("e")).select("c", "key", "task", F.col("e.at").alias("blk"), "e.side")
    left = blocked.join(sets, "h").join(tasks, ["c", "key", "blk"]).withColumn("whole", F.lit(False))
    return edges.unionByName(_compared(left, similarity)).distinct()
