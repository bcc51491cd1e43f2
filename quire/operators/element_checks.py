"""Guideline checks of manuscript elements that need no language model.

Rules are rows: element, guideline, and an expression over the element's text that says whether the guideline is followed. What a
model has to judge (names, wording) comes from a table of responses instead; see quire.functions.titles.parse_objects().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import patterns as rx
from quire.functions.text import squeeze, strip

# Fixed values.
CONTRIBUTOR_ROLES = [
    "Conceptualization", "Data curation", "Formal analysis", "Funding acquisition", "Investigation", "Methodology", "Project administration", "Resources", "Software", "Supervision", "Validation", "Visualization",
    "Writing - original draft", "Writing - review & editing",
]
ACKNOWLEDGMENT_PARTS = ["Acknowledgments", "Disclaimers:", "Supported by:", "Presented at:", "Funding:", "Declaration of interest:"]


def _has(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def _roles(c: Column) -> Column:
    """The roles that a contributor statement names, after each person's colon."""
    people = F.filter(F.split(F.regexp_replace(c, r"(?i)^\s*CRediT Author Statement\s*", ""), ";"), lambda p: p.contains(":"))
    return F.flatten(F.transform(people, lambda p: F.transform(F.split(F.substr(p, F.instr(p, ":") + 1), ","), lambda r: F.regexp_replace(squeeze(r), r"\.\z", ""))))


def _parts_in_order(c: Column) -> Column:
    places = F.filter(F.array(*[F.instr(c, p) for p in ACKNOWLEDGMENT_PARTS]), lambda i: i > 0)
    return places == F.array_sort(places)


def _superscripts(c: Column) -> Column:
    """Numbers right after a letter, in order of their first use."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?<=[A-Za-z])(\d{1,2})"), F.lit(1)), lambda x: x.cast("int")))


#: (element, guideline, followed): the subset that text alone decides.
RULES = [
    ("title", "title_form_constraint", lambda c: ~_has(c, r"\?\s*\z|^\s*(?i:the (relationship|effect|association|impact) of)\b")),
    ("title", "title_hyphenation_constraint", lambda c: ~_has(c, r"[A-Za-z]-[A-Za-z]")),
    ("title", "subtitle_placement_and_separator", lambda c: ~_has(c, r"[\r\n]")),
    ("authors", "academic_degree", lambda c: _has(c, rx.DEGREES)),
    ("authors", "affiliation_sequence", lambda c: _superscripts(c) == F.array_sort(_superscripts(c))),
    ("authors", "working_group", lambda c: ~_has(c, r"(?i)\band\b")),
    ("correspondence", "start_constraint", lambda c: c.startswith("Address correspondence to:")),
    ("correspondence", "degrees_constraint", lambda c: _has(c, rx.DEGREES)),
    ("correspondence", "email_constraint", lambda c: _has(c, rx.EMAIL)),
    ("correspondence", "abbreviation_constraint", lambda c: ~_has(c, r"\b(St|Ave|Rd|Dr|Blvd|Ln|Dept|Univ)\.")),
    ("correspondence", "phone_constraint", lambda c: ~_has(c, r"(?i)\b(phone|tel|telephone)\b")),
    ("correspondence", "fax_constraint", lambda c: ~_has(c, r"(?i)\bfax\b")),
    ("correspondence", "title_constraint", lambda c: ~_has(c, r"\b(Dr|Mr|Mrs|Ms|Prof)\.? [A-Z]")),
    ("correspondence", "end_constraint", lambda c: c.endswith(".")),
    ("acknowledgments", "start_constraint", lambda c: _has(c, r"^ACKNOWLEDGMENTS\s*\n")),
    ("acknowledgments", "sections_constraint", _parts_in_order),
    ("acknowledgments", "end_constraint", lambda c: _has(c, r"(?i)declaration of interest:[^:]*\z")),
    ("credit", "start_constraint", lambda c: _has(c, r"^CRediT Author Statement\s*\n")),
    ("credit", "fullname_constraint", lambda c: ~_has(c, r"(?:^|[;\n])\s*(?:[A-Z]\.?\s*){2,}:")),
    ("credit", "role_constraint", lambda c: F.forall(_roles(c), lambda r: r.isin(CONTRIBUTOR_ROLES))),
    ("credit", "format_constraint", lambda c: F.size(F.split(c, ":")) - 1 <= F.size(F.split(c, ";"))),
]


def check_elements(elements: DataFrame, element: str = "element", text: str = "text") -> DataFrame:
    """elements: any columns, element and text. One row per rule of the element: guideline_id, followed, source.

    Empty and null texts have no rows. Rules of an element are tried in one projection: no join, no shuffle."""
    kept = [c for c in elements.columns if c not in (element, text)]
    t = strip(F.coalesce(F.col(text), F.lit("")))
    rules = [F.when(F.col(element) == e, F.struct(F.lit(g).alias("guideline_id"), F.coalesce(f(F.col("__t")), F.lit(False)).alias("followed"))) for e, g, f in RULES]
    rows = elements.withColumn("__t", t).filter("__t <> ''").select(*kept, F.col(element), F.explode(F.array_compact(F.array(*rules))).alias("r"))
    return rows.select(*kept, element, "r.guideline_id", "r.followed", F.lit("deterministic").alias("source"))


def rich_spans(text: Column, spans: Column, color: str = "FFFF0000") -> Column:
    """A text as array of (text, highlighted, color): sorted spans (start, end) are highlighted, the rest is plain."""
    edges = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), spans.cast("array<struct<start:int,end:int>>"), F.array(F.struct(F.length(text).alias("start"), F.length(text).alias("end"))))
    piece = lambda a, b, on: F.struct(F.substr(text, a + 1, b - a).alias("text"), F.lit(on).alias("highlighted"), F.lit(color if on else None).cast("string").alias("color"))
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.size(edges)), lambda i: F.array(
        piece(F.element_at(edges, i - 1)["end"], F.element_at(edges, i)["start"], False), piece(F.element_at(edges, i)["start"], F.element_at(edges, i)["end"], True))))
    return F.filter(parts, lambda p: p["text"] != "")


def highlight_first(text: Column, target: Column, color: str = "FFFF0000") -> Column:
    """The same with the first occurrence of a target; the whole text plain without one."""
    at = F.instr(text, target)
    none = F.array().cast("array<struct<start:int,end:int>>")
    found = F.array(F.struct((at - 1).cast("int").alias("start"), (at - 1 + F.length(target)).cast("int").alias("end")))
    return rich_spans(text, F.when((at > 0) & (target != ""), found).otherwise(none), color)
