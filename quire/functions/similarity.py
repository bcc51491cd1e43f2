"""The similarity of short names as column expressions.

100 times twice the longest common subsequence over both lengths. The subsequence comes from the bit-parallel recurrence: one word holds a
row of the table, one bit for each character of the name, and a step per character of the other text is an addition and three bit
operations. Lengths and letters rule out most pairs before.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import let

#: Characters of a name: one word without its two highest bits, so that the addition cannot overflow.
WORD = 62


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _masks(name: Column) -> Column:
    """Of each character of a name, the bits of its places."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
    return let(_chars(name), lambda a: F.map_from_entries(F.transform(F.array_distinct(a), lambda x: F.struct(x.alias("key"), F.aggregate(F.transform(a, lambda y, i: F.when(y == x, bit(i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, v: s.bitwiseOR(v)).alias("value")))))


def _common(masks: Column, n: Column, chars: Column) -> Column:
    """The length of the longest common subsequence of a name, given by its masks and its length, and characters."""
    full = F.call_function("shiftleft", F.lit(1).cast("bigint"), n) - F.lit(1).cast("bigint")

    def step(row: Column, x: Column) -> Column:
        return let(F.struct(row.alias("v"), row.bitwiseAND(F.coalesce(F.try_element_at(masks, x), F.lit(0).cast("bigint"))).alias("u")), lambda s: (s["v"] + s["u"]).bitwiseOR(s["v"] - s["u"]).bitwiseAND(full))

    return n - F.bit_count(F.aggregate(chars, full, step))


def name_similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """The similarity of two texts, 0 to 100; two empty ones are equal. Below ``least`` it is 0. Null where either is null, and where both
    are longer than WORD characters: those are no short names."""
    m, n = F.length(a), F.length(b)
    name, other = F.when(m <= n, a).otherwise(b), F.when(m <= n, b).otherwise(a)
    bound = 200.0 * F.least(m, n) / (m + n)
    score = let(F.struct(_masks(name).alias("m"), F.length(name).alias("n"), _chars(other).alias("c")), lambda s: 200.0 * _common(s["m"], s["n"], s["c"]) / (m + n))
    out = F.when((m == 0) & (n == 0), 100.0).when(bound < least, 0.0).when(F.least(m, n) <= WORD, score)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(out < least, 0.0).otherwise(out))


def best_name(text: Column, names: dict[str, list[str]], least: float) -> Column:
    """struct(kind, score) of the most similar of some names by kind, the first of equals; null if none reaches ``least``. Names that are
    too short or too long for the text are passed over."""
    rows = [(v, t) for t, known in names.items() for v in known]
    if any(len(v) > WORD for v, _ in rows):
        raise ValueError(f"names have at most {WORD} characters")
    masks = lambda v: F.create_map(*[F.lit(z) for x in dict.fromkeys(v) for z in (x, sum(1 << i for i, y in enumerate(v) if y == x))]).cast("map<string,bigint>")
    known = F.array(*[F.struct(F.lit(t).alias("kind"), F.lit(len(v)).alias("n"), masks(v).alias("m")) for v, t in rows])

    def scored(t: Column) -> Column:
        near = F.filter(known, lambda k: 200.0 * F.least(k["n"], t["n"]) >= least * (k["n"] + t["n"]))
        scores = F.transform(near, lambda k: F.struct(k["kind"].alias("kind"), (200.0 * _common(k["m"], k["n"], t["c"]) / (k["n"] + t["n"])).alias("score")))
        return F.reduce(F.filter(scores, lambda s: s["score"] >= least), F.lit(None).cast("struct<kind:string,score:double>"), lambda a, s: F.when(a.isNull() | (s["score"] > a["score"]), s).otherwise(a))

    return F.when(text.isNotNull(), let(F.struct(F.length(text).alias("n"), _chars(text).alias("c")), scored))
