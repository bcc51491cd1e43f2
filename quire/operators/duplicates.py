"""Duplicate sections of a document: candidate pairs by length and containment, a similarity for those that can reach it, and a fold
over the pairs in document order.

Everything happens in the document's row. Candidates, decisions and messages are column expressions; Python gets the pairs of texts whose
similarity decides or is reported, and nothing else.
"""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.lexicon import BODY
from quire.functions.text import count_of, let, norm_for_similarity

# Types whose sections are compared with each other, types that a document has once, and the numbers of both rules.
COMPARED_TYPES = sorted(BODY | set(
    "abstract keywords highlights credit_statement funding declaration_of_interest front_metadata affiliations correspondence orcid running_head authors title_page_marker title disclaimer "
    "data_availability acknowledgments".split()
))
SINGLE_TYPES = sorted("declaration_of_interest credit_statement acknowledgments funding data_availability ethics".split())
CHECKBOXES = "☐☑☒"
#: Shortest texts, and texts below which only near equality counts; similarities; how much longer a later text must be to be the primary one.
#: Texts are compared whole.
SHORTEST, SHORT, ALIKE, SHORT_ALIKE, LONGER = 12, 25, 0.65, 0.9, 1.3
#: A restatement is this far away or this short; and what a duplicate loses in confidence.
FAR, STUB, PENALTY = 2000, 40, 0.15


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """The similarity of two texts; 0 if cheap upper bounds are below ``least``."""
    m = difflib.SequenceMatcher(None, a, b)
    return 0.0 if least and (m.real_quick_ratio() < least or m.quick_ratio() < least) else m.ratio()


def ratios(pairs: Column) -> Column:
    """pairs: array of structs with x, y and least, or null where a document has none. One similarity each."""
    @F.arrow_udf("array<double>")
    def ratios(batch: pa.Array) -> pa.Array:
        return pa.array([None if row is None else [ratio(p["x"], p["y"], p["least"]) for p in row] for row in batch.to_pylist()], pa.list_(pa.float64()))

    texts = F.transform(pairs, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["least"].alias("least")))
    return F.coalesce(ratios.asNondeterministic()(F.when(F.size(pairs) > 0, texts)), F.array().cast("array<double>"))


def _pairs(s: Column) -> Column:
    """s: the sections that are compared, in order. Pairs of one type that could be duplicates."""
    def of(a: Column, i: Column) -> Column:
        later = F.filter(F.slice(s, i + 2, F.size(s)), lambda b: b["section_type"] == a["section_type"])
        return F.transform(later, lambda b: pair(a, b))

    def pair(a: Column, b: Column) -> Column:
        na, nb = F.length(a["t"]), F.length(b["t"])
        short = F.least(na, nb)
        contained = F.contains(a["t"], b["t"]) | F.contains(b["t"], a["t"])
        inside = (short >= SHORT) & contained
        need = F.when(short < SHORT, SHORT_ALIKE).otherwise(ALIKE)
        swap = nb >= LONGER * na
        possible = (short >= SHORTEST) & (inside | (2 * short >= need * (na + nb)))
        return F.struct(F.when(swap, a["id"]).otherwise(b["id"]).alias("dup"), F.when(swap, b["id"]).otherwise(a["id"]).alias("primary"), a["t"].alias("x"), b["t"].alias("y"),
                        contained.alias("contained"), inside.alias("inside"), need.alias("need"), F.when(inside, 0.0).otherwise(need).alias("least"), possible.alias("possible"))

    compared = F.filter(F.flatten(F.transform(s, of)), lambda p: p["possible"])
    return F.when(F.size(s) > 1, compared)


FLAG = "array<struct<dup:int,primary:int,why:string,back:string>>"


def _flags(pairs: Column, ratios: Column) -> Column:
    """The pairs that count, in order: neither section is a duplicate yet, and they are alike."""
    def step(flags: Column, x: Column) -> Column:
        p, r = x["p"], x["r"]
        free = ~F.exists(flags, lambda f: f["dup"].isin(p["dup"], p["primary"]))
        alike = p["inside"] | (r >= p["need"])
        text = F.format_string("%.2f", r)
        flag = F.struct(p["dup"].cast("int").alias("dup"), p["primary"].cast("int").alias("primary"),
                        F.concat(F.lit("near-duplicate-of:"), p["primary"].cast("string"), F.lit(" similarity="), text, F.when(p["contained"], " contained").otherwise("")).alias("why"),
                        F.concat(F.lit("has-near-duplicate:"), p["dup"].cast("string"), F.lit(" similarity="), text).alias("back"))
        return F.when(free & alike, F.concat(flags, F.array(flag))).otherwise(flags)

    return F.aggregate(F.zip_with(pairs, ratios, lambda p, r: F.struct(p.alias("p"), r.alias("r"))), F.array().cast(FLAG), step)


def _restated(s: Column, flags: Column) -> Column:
    """Sections of a single type beside a better one of it: far away, with check boxes, or stubs."""
    left = F.filter(s, lambda x: x["section_type"].isin(SINGLE_TYPES) & ~F.exists(flags, lambda f: f["dup"] == x["id"]))

    def of(kind: str) -> Column:
        group = F.filter(left, lambda x: x["section_type"] == kind)
        best = F.array_min(F.transform(group, lambda x: F.struct(x["boxes"].alias("boxes"), x["parent_id"].isNull().alias("top"), (-x["n"]).alias("n"), x["start_position"].alias("start_position"), x["id"].alias("id"), x["end_position"].alias("end_position"), x["t"].alias("t"))))

        def restated(x: Column, p: Column) -> Column:
            gap = F.greatest(x["start_position"] - p["end_position"], p["start_position"] - x["end_position"], F.lit(0))
            why = F.concat_ws(" ", F.when(gap >= FAR, F.format_string("gap(%d)", gap)), F.when(x["boxes"] > 0, F.format_string("checkboxes(%d)", x["boxes"])), F.when(F.length(x["t"]) < STUB, F.lit("stub")))
            return F.struct(x["id"].alias("dup"), p["id"].alias("primary"), p["t"].alias("x"), x["t"].alias("y"), F.lit(0.0).alias("least"), why.alias("why"))

        others = let(best, lambda p: F.filter(F.transform(group, lambda x: restated(x, p)), lambda q: (q["dup"] != q["primary"]) & (q["why"] != "")))
        return others

    return F.flatten(F.array(*[of(kind) for kind in SINGLE_TYPES]))


def _more_flags(restated: Column, ratios: Column) -> Column:
    text = lambda r: F.format_string("%.2f", r)
    return F.zip_with(restated, ratios, lambda p, r: F.struct(
        p["dup"].cast("int").alias("dup"), p["primary"].cast("int").alias("primary"),
        F.concat(F.lit("restates:"), p["primary"].cast("string"), F.lit(" similarity="), text(r), F.lit(" "), p["why"]).alias("why"),
        F.concat(F.lit("restated-by:"), p["dup"].cast("string"), F.lit(" similarity="), text(r)).alias("back")))


NAMES = ("id", "parent_id", "section_type", "name", "level", "start_block", "end_block", "start_position", "end_position", "extracted_text", "confidence", "evidence", "flags")


def settle_duplicates(docs: DataFrame) -> DataFrame:
    """docs: doc_id, sections (an array, in order) and any other columns, which stay. Sections get duplicate_of (the end of a chain of duplicates); duplicates lose
    confidence; uncertain follows from it. Only documents in which a type occurs again are compared."""
    wanted = F.filter("sections", lambda s: s["section_type"].isin(sorted({*COMPARED_TYPES, *SINGLE_TYPES})))
    again = F.size(F.array_distinct(F.transform(wanted, lambda s: s["section_type"]))) < F.size(wanted)

    def reduced(s: Column) -> Column:
        whole = norm_for_similarity(s["extracted_text"])
        return F.struct(*[s[n].alias(n) for n in ("id", "parent_id", "section_type", "start_position", "end_position")], F.length(s["extracted_text"]).alias("n"), whole.alias("t"),
                        count_of(s["extracted_text"], f"[{CHECKBOXES}]").alias("boxes"))

    rest = [c for c in docs.columns if c not in ("doc_id", "sections")]
    df = docs.select("doc_id", *rest, "sections", F.when(again, F.transform(wanted, reduced)).alias("s"))
    df = df.withColumn("pairs", _pairs(F.filter("s", lambda x: x["section_type"].isin(COMPARED_TYPES))))
    df = df.withColumn("r", ratios(F.col("pairs")))
    df = df.select("doc_id", *rest, "sections", "s", F.coalesce(_flags(F.col("pairs"), F.col("r")), F.array().cast(FLAG)).alias("found"))
    df = df.withColumn("again", F.when(F.col("s").isNotNull(), _restated(F.col("s"), F.col("found"))))
    df = df.withColumn("r", ratios(F.col("again")))
    df = df.select("doc_id", *rest, "sections", F.concat("found", F.coalesce(_more_flags(F.col("again"), F.col("r")), F.array().cast(FLAG))).alias("found"))

    def settled(s: Column) -> Column:
        own = F.filter("found", lambda f: f["dup"] == s["id"])
        primary = F.get(own, F.lit(0))["primary"]
        follow = lambda at, _: F.coalesce(F.get(F.filter("found", lambda f: f["dup"] == at), F.lit(0))["primary"], at)
        end = F.when(primary.isNotNull(), F.aggregate("found", primary, follow))
        said = F.transform(F.filter("found", lambda f: (f["dup"] == s["id"]) | (f["primary"] == s["id"])), lambda f: F.when(f["dup"] == s["id"], f["why"]).otherwise(f["back"]))
        sure = F.greatest(F.lit(0.15), F.least(F.lit(0.97), s["confidence"] - PENALTY * F.size(own)))
        changed = {"confidence": sure, "evidence": F.concat(s["evidence"], said)}
        return F.struct(*[changed.get(n, s[n]).alias(n) for n in NAMES], end.alias("duplicate_of"), (sure < 0.7).alias("uncertain"))

    def untouched(s: Column) -> Column:
        sure = F.greatest(F.lit(0.15), F.least(F.lit(0.97), s["confidence"]))
        return F.struct(*[sure.alias(n) if n == "confidence" else s[n].alias(n) for n in NAMES], F.lit(None).cast("int").alias("duplicate_of"), (sure < 0.7).alias("uncertain"))

    return df.select("doc_id", F.when(F.size("found") > 0, F.transform("sections", settled)).otherwise(F.transform("sections", untouched)).alias("sections"), *rest)
