"""Titles: abbreviations, letter case, guideline edits; and JSON objects in free text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from quire.functions.text import WS, words

# Fixed values.
ABBREVIATION_STOP = set("THE AND FOR WITH FROM THIS THAT TABLE FIGURE RESULTS METHODS INTRODUCTION DISCUSSION CONCLUSION ABSTRACT KEYWORDS E.G. CI".split())
ABBREVIATIONS = {
    "uppercase": r"\b[A-Z]{2,}(?:[A-Z0-9-]*)\b",
    "dotted": r"\b(?:[A-Za-z]\.){2,}",
    "scientific": r"\b[A-Za-z][A-Za-z0-9]*(?:[-/][A-Za-z0-9α-ωΑ-Ω]+)+\b",
    "gene": r"\b(?:[A-Za-z]{1,6}\d+[A-Za-z+-]*|\d+[A-Za-z]{1,6})\b",
    "camel": r"\b[a-z]{1,3}[A-Z]{2,}[A-Za-z0-9-]*\b",
    "greek": r"\b(?:[A-Za-z]+-?[α-ωΑ-Ω]+|[α-ωΑ-Ω]+-?[A-Za-z0-9]+)\b",
    "chemical": r"\b(?:[A-Z][a-z]?\d*){2,}\b",
}
SMALL_WORDS = "a an the and or nor but as at by for from in into of on onto per to up via with without".split()
PREPOSITIONS = (
    "about above across after against along around before behind below beneath beside between beyond during inside outside over past round since through throughout toward towards under "
    "underneath until upon within without like".split()
)
CONJUNCTIONS = "and but or nor for yet so".split()
#: Closed classes that a tagger would find: the rest of the prepositions, determiners and pronouns.
CLOSED_CLASS = (
    "at by down from in into near of off on onto out per to up via with as than amid among amongst despite except "
    "a an the this that these those each every either neither some any no all both half such what which whose "
    "i you he she it we they me him her us them my your his its our their mine yours hers ours theirs who whom myself yourself himself herself itself ourselves themselves someone anyone everyone "
    "nobody nothing something anything everything".split()
)
MATCH = "array<struct<text:string,start:int,end:int,type:string>>"
_COMPILED = [(n, re.compile(p)) for n, p in ABBREVIATIONS.items()]


def abbreviations_of(text: str) -> list[dict]:
    """Matches of all patterns; where they overlap, the earlier start wins, then the longer."""
    found = [(m.start(), -len(m.group()), k, m.group(), n) for k, (n, rx) in enumerate(_COMPILED) for m in rx.finditer(text) if m.group().upper() not in ABBREVIATION_STOP]
    out, end = [], -1
    for start, size, _, token, kind in sorted(found, key=lambda x: x[:3]):
        if start >= end:
            out.append({"text": token, "start": start, "end": start - size, "type": kind})
            end = start - size
    return out


def abbreviations_udf():
    @F.pandas_udf(MATCH)
    def abbreviations(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: abbreviations_of(t or ""))

    return abbreviations


def _capitalize_token(t: Column, first: Column) -> Column:
    upper = t.rlike(r"\p{Lu}") & ~t.rlike(r"[\p{Ll}\p{Lt}]")
    mixed = t.rlike(r"\p{Ll}") & t.rlike(r"\p{Lu}")
    keep = ((F.length(t) > 1) & upper) | mixed | t.rlike(r"^[α-ωΑ-Ω]+\z")
    return F.when(keep, t).when(~first & F.lower(t).isin(SMALL_WORDS), F.lower(t)).otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2)))))


def capitalize_expansion(c: Column) -> Column:
    """Title case of an expansion: acronyms, mixed case and Greek stay; small words are lower but at the start."""
    def word(w: Column, i: Column) -> Column:
        return F.array_join(F.transform(F.split(w, "-"), lambda p, j: _capitalize_token(p, (i == 0) & (j == 0))), "-")

    return F.array_join(F.transform(words(c), word), " ")


def fix_title_case(c: Column) -> Column:
    """Prepositions, conjunctions, determiners and pronouns after the first word: capitalised from four letters on, else lower case.

    Words are found in closed lists instead of by a tagger."""
    parts = F.regexp_extract_all(c, F.lit(rf"[\p{{L}}]+|[^\p{{L}}{WS}]+|[{WS}]+"), F.lit(0))
    known = sorted({*PREPOSITIONS, *CONJUNCTIONS, *CLOSED_CLASS})

    def fixed(p: Column, i: Column) -> Column:
        low = F.lower(p)
        return F.when((i > 0) & low.isin(known), F.when(F.length(low) >= 4, F.concat(F.upper(F.substring(low, 1, 1)), F.substr(low, F.lit(2)))).otherwise(low)).otherwise(p)

    return F.array_join(F.transform(parts, fixed), "")


def title_case_edits(titles: DataFrame, key: str, title: str) -> DataFrame:
    """key, part, pos, affected_text and suggested_replacement: words whose case changes in the title and, after its first colon, the
    subtitle up to the second."""
    halves = F.when(F.col(title).contains(":"), F.slice(F.split(title, ":"), 1, 2)).otherwise(F.array(F.col(title)))
    rows = titles.select(F.col(key).alias("key"), F.posexplode(halves).alias("part", "t"))
    rows = rows.select("key", "part", F.posexplode(F.arrays_zip(words(F.col("t")).alias("old"), words(fix_title_case(F.col("t"))).alias("new"))).alias("pos", "w"))
    return rows.filter("w.old <> w.new").select("key", "part", "pos", F.col("w.old").alias("affected_text"), F.col("w.new").alias("suggested_replacement"))


def abbreviation_edits(verdicts: DataFrame) -> DataFrame:
    """verdicts: term, valid_abbreviation, expanded_form, equivalent_in_common_list. Edits for valid ones that are no standard form."""
    standard = F.col("equivalent_in_common_list")
    none = standard == "NA"
    rows = verdicts.filter(F.col("valid_abbreviation") & (none | (F.trim("term") != F.trim(standard))))
    return rows.select(
        *[c for c in verdicts.columns if c not in ("valid_abbreviation", "expanded_form", "equivalent_in_common_list", "term")],
        F.lit(False).alias("guideline_followed"), F.lit("title_abbreviation_constraint").alias("guideline_id"),
        F.when(none, "Uncommon Abbreviations not allowed in titles").otherwise("kindly use this standard form").alias("reason"), F.col("term").alias("affected_text"),
        F.when(none, capitalize_expansion(F.col("expanded_form"))).otherwise(standard).alias("suggested_replacement"),
    )


def json_objects_of(text: str) -> list[str]:
    """The top-level {...} of a text; braces in strings do not count, and a backslash hides the next character anywhere."""
    out: list[str] = []
    depth, start, quoted, skip = 0, None, False, False
    for i, ch in enumerate(text):
        if skip:
            skip = False
        elif ch == "\\":
            skip = True
        elif ch == '"':
            quoted = not quoted
        elif not quoted and ch == "{":
            if depth == 0:
                start = i
            depth += 1
        elif not quoted and ch == "}":
            depth -= 1
            if depth == 0 and start is not None:
                out.append(text[start : i + 1])
    return out


def json_objects_udf():
    @F.pandas_udf("array<string>")
    def json_objects(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: json_objects_of(t or ""))

    return json_objects


def repair_json(c: Column) -> Column:
    """Small repairs: Python's literals, bare keys, trailing commas."""
    c = F.regexp_replace(c, r"(?<=[:\[,]\s{0,9})True\b", "true")
    c = F.regexp_replace(F.regexp_replace(c, r"(?<=[:\[,]\s{0,9})Fal?se?\b|(?<=[:\[,]\s{0,9})Flase\b", "false"), r"(?<=[:\[,]\s{0,9})None\b", "null")
    c = F.regexp_replace(c, r"([{,]\s*)([A-Za-z_]\w*)(\s*:)", '$1"$2"$3')
    return F.regexp_replace(c, r",\s*([}\]])", "$1")


def parse_objects(df: DataFrame, response: str, schema: str) -> DataFrame:
    """One row per JSON object of a response, with pos, the object's text and its fields as ``parsed`` (null if it cannot be read)."""
    rows = df.select(*[c for c in df.columns if c != response], F.posexplode(json_objects_udf()(F.col(response))).alias("pos", "object"))
    return rows.withColumn("parsed", F.from_json(repair_json(F.col("object")), schema, {"mode": "PERMISSIVE", "allowSingleQuotes": "true"}))


def chat_payload(system: Column, user: Column, model: str) -> Column:
    """A request for a hosted model: system, acknowledgement and user messages, temperature 0."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.lit(0).alias("temperature"), F.array(message("system", system), message("assistant", F.lit("Okay")), message("user", user)).alias("messages")))


def register(spark) -> None:
    """SQL functions: abbreviations(text), json_objects(text), and the table function json_rows(text)."""
    spark.udf.register("abbreviations", abbreviations_udf())
    spark.udf.register("json_objects", json_objects_udf())
    spark.udtf.register("json_rows", json_rows())


def json_rows() -> UserDefinedTableFunction:
    class JsonRows:
        def eval(self, text: str):
            for i, o in enumerate(json_objects_of(text or "")):
                yield i, o

    return F.udtf(JsonRows, returnType="pos int, object string")
