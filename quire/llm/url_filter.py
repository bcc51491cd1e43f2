"""URL filters by a Bloom filter cascade.

Level 1 encodes the listed keys. Level 2 encodes those unlisted keys of the corpus that pass level 1, level 3 those listed
keys that pass level 2, and so on until a level lets nothing of the other kind through. The key universe is every key that
any url of the corpus can produce, so membership is exact for the corpus, and a test is a few bit probes: no join.

Keys are ``host suffix + path prefix`` strings such as ``example.org/en/``. A rule is such a key with a verdict.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, settle

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: Beyond this many bits in level 1 the filter is not sent to the executors; rules are then joined by key.
MAX_FILTER_BITS = 1 << 24


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits as 64-bit words."""

    salt: int
    bits: int
    probes: int
    words: tuple[int, ...]

    def positions(self, key: Column) -> list[Column]:
        return _positions(key, self.salt, self.bits, self.probes)

    def contains(self, key: Column) -> Column:
        # A folded literal array: parsed once per plan, read by index.
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        out = F.lit(True)
        for p in self.positions(key):
            word = F.get(words, F.shiftright(p, 6).cast("int"))
            out = out & _bit(word, p)
        return out


def _bit(word: Column, p: Column) -> Column:
    return F.call_function("getbit", word, p.bitwiseAND(F.lit(63)).cast("int")) == 1


def _positions(key: Column, salt: int, bits: int, probes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(salt), F.lit(i)), F.lit(bits)) for i in range(probes)]


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Listed if and only if the first level that rejects the key has an even number."""
        out = F.lit(False) if len(self.levels) % 2 == 0 else F.lit(True)
        for level in reversed(self.levels):
            # what remains after this level, if the key passes it; a rejected key is of the other kind than the level encodes
            encodes_listed = level.salt % 2 == 1
            out = F.when(level.contains(key), out).otherwise(F.lit(not encodes_listed))
        return out

    @property
    def bits(self) -> int:
        return sum(x.bits for x in self.levels)


def _level(keys: DataFrame, salt: int, n: int, rate: float) -> Level | None:
    """The filter of the distinct keys in column ``key``; None if there are none. At most ``bits / 64`` rows reach the driver."""
    bits = max(64, 64 * math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))
    probes = max(1, round(bits / max(n, 1) * math.log(2))) if rate < 0.5 else 1
    probes = min(probes, 16)
    hits = keys.select(F.explode(F.array(*_positions(F.col("key"), salt, bits, probes))).alias("p"))
    words = (
        hits.groupBy(F.shiftright("p", 6).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
        .collect()
    )
    if not words:
        return None
    out = [0] * (bits // 64)
    for r in words:
        out[r.w] = r.b
    return Level(salt, bits, probes, tuple(out))


def build_cascade(listed: DataFrame, universe: Callable[[Level], DataFrame], rate: float = 0.01, max_levels: int = 64) -> Cascade:
    """listed: distinct ``key`` rows. universe(level): ``key`` rows of the corpus that pass the first level, repeats allowed.

    Only what passes level 1 is gathered and made distinct, so the shuffle has the false positives, not the corpus.
    """
    n = listed.count()
    first = _level(listed, 1, n, rate)
    if first is None:
        return Cascade(())
    tagged = universe(first).select("key", F.lit(0).alias("is_listed")).unionByName(listed.select("key", F.lit(1).alias("is_listed")))
    rest = settle(tagged.groupBy("key").agg(F.max("is_listed").alias("is_listed")))
    levels = [first]
    while len(levels) < max_levels:
        want = len(levels) % 2  # level 2 (one so far) encodes what is not listed
        keys = rest.filter(F.col("is_listed") == 1 - want)
        # a level only has to hold keys of its kind that every earlier level of the other kind lets through
        for level in levels:
            keys = keys.filter(level.contains(F.col("key")))
        m = keys.count()
        level = _level(keys, len(levels) + 1, m, 0.5) if m else None
        if level is None:
            return Cascade(tuple(levels))
        levels.append(level)
    raise RuntimeError(f"the cascade did not end within {max_levels} levels")


def candidate_keys(host: Column, path: Column, label_counts: list[int], path_lengths: list[int]) -> Column:
    """Every host suffix joined to every path prefix that a rule of these shapes could equal; longest first."""
    parts = []
    for n in sorted(label_counts):
        suffix = F.substring_index(host, ".", -n)
        for size in sorted(path_lengths):
            parts.append(F.when(F.length(path) >= size, F.concat(suffix, F.left(path, F.lit(size)))))
    keys = F.array_distinct(F.array_compact(F.array(*parts)))
    order = F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))
    return F.transform(F.array_sort(order), lambda s: s["k"])


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", id_cols: tuple[str, ...] = ("page_id",),
               max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """Judges every url. rules: columns host, path, verdict (allow or block); pages: id_cols and url.

    The longest rule whose host is the url's host or a parent domain and whose path starts the url's path decides. A url that
    no rule fits is a key outside the list: the cascade says so exactly, and it gets ``default``.

    Null urls and urls without ``://`` have empty host and path and no rule; urls with ``://`` and no host (``file:///x``) are judged
    like others. Of two rules of one length that fit (``a.com/`` and ``com/ab``) the smaller key decides, on either path. Repeated
    pages are judged each. A rule listed twice counts once; if its verdicts differ, block wins. Null rule hosts or paths are dropped. Without rules or pages the
    result has default verdicts or no rows. Other columns of pages are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(*id_cols, F.col(url).alias("__url"))
    rows = rows.select(*id_cols, host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    list_ = (
        rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull())
        .select(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("plen"),
                F.when(F.col("verdict") == "allow", 1).otherwise(0).alias("allow"))
        .groupBy("key").agg(F.max("labels").alias("labels"), F.min("plen").alias("plen"), F.min("allow").alias("allow"))
    )
    list_ = settle(list_)
    shape = list_.agg(F.count("*").alias("n"), F.collect_set("labels").alias("labels"), F.collect_set("plen").alias("plens")).first()
    if not shape.n:
        return rows.select(*id_cols, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = candidate_keys(F.col("host"), F.col("path"), shape.labels, shape.plens)
    if shape.n * 10 > max_filter_bits:
        return _by_join(rows.withColumn("__keys", keys), list_, default, id_cols)

    def passing(level: Level) -> DataFrame:
        kept = F.filter(keys, lambda k: level.contains(k))
        return rows.select(F.explode(kept).alias("key"))

    is_listed = build_cascade(list_.select("key"), passing)
    # Verdicts: among the listed keys, which are allowed. That universe is the list itself.
    is_allowed = build_cascade(list_.filter("allow = 1").select("key"), lambda level: list_.select("key").filter(level.contains(F.col("key"))))
    rule = F.get(F.filter(keys, lambda k: is_listed.contains(k)), F.lit(0))
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(is_allowed.contains(F.col("rule")) if is_allowed.levels else F.lit(False), F.lit("allow")).otherwise(F.lit("block"))
    return rows.select(*id_cols, "host", "path", rule.alias("rule")).select(*id_cols, "host", "path", "rule", verdict.alias("verdict"))


def _by_join(rows: DataFrame, list_: DataFrame, default: str, id_cols: tuple[str, ...]) -> DataFrame:
    """For lists over the size bound: judge each distinct (host, path) once by an equi-join on keys, then attach the verdicts."""
    urls = rows.select("host", "path", "__keys").distinct()
    found = urls.select("host", "path", F.explode("__keys").alias("key")).join(list_.select("key", "allow"), "key")
    best = found.groupBy("host", "path").agg(F.min_by(F.struct("key", "allow"), F.struct(-F.length("key"), F.col("key"))).alias("r"))
    out = rows.select(*id_cols, "host", "path").join(best, ["host", "path"], "left")
    return out.select(*id_cols, "host", "path", F.col("r.key").alias("rule"),
                      F.when(F.col("r.key").isNull(), F.lit(default)).when(F.col("r.allow") == 1, F.lit("allow")).otherwise(F.lit("block")).alias("verdict"))


#: The rules of the registered query (fixed values).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP1_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (SELECT row_number() OVER () AS rid, * FROM u),
m AS (
  SELECT rid, page_id, host, path, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC NULLS LAST, rhost || rpath) AS k
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE k = 1
"""
