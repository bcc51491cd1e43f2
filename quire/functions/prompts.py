"""Requests to language models: what each check asks, and what comes back.

A prompt has a task, the guidelines as "id: text" lines, examples and the form of the answer. The texts are this engine's own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.functions.titles import chat_payload, parse_objects

#: What is asked in each check, and the fields of each object of the answer.
EDIT = "guideline_followed boolean, guideline_id string, reason string, affected_text string, suggested_replacement string, edit_score double"
TERM = "term string, valid_abbreviation boolean, expanded_form string, equivalent_in_common_list string"
PART = "section string, text string"
TASKS: dict[str, tuple[str, str]] = {
    "title": ("Check the title of a scientific paper against the guidelines and propose the smallest edits that make it follow them.", EDIT),
    "abbreviations": ("Say for every term whether it is an abbreviation, what it stands for, and which form a list of common abbreviations gives it, or NA.", TERM),
    "authors": ("Check the list of authors of a scientific paper against the guidelines and propose the smallest edits that make it follow them.", EDIT),
    "authors_review": ("Check earlier findings on a list of authors: keep those that the guidelines support, and drop or correct the rest.", EDIT),
    "correspondence": ("Check the address for correspondence of a scientific paper against the guidelines and propose the smallest edits that make it follow them.", EDIT),
    "credit": ("Check the contributor statement of a scientific paper against the guidelines and propose the smallest edits that make it follow them.", EDIT),
    "acknowledgments": ("Check the acknowledgments of a scientific paper against the guidelines and propose the smallest edits that make it follow them.", EDIT),
    "acknowledgment_parts": ("Divide the acknowledgments of a scientific paper into the listed parts, without changing a word.", PART),
    "acknowledgment_order": ("Check that the parts of the acknowledgments come in the listed order, and name those that do not.", EDIT),
}
RULES = "Judge every guideline by its id. Invent none. Keep the meaning. Give reasons in a few words."


def answer_form(schema: str) -> str:
    fields = ", ".join(f'"{f.split()[0]}": {f.split()[1]}' for f in schema.split(", "))
    return "Answer with one JSON array of objects {" + fields + "} and nothing else."


def prompt(check: str, guidelines: Mapping[str, str], examples: Mapping[str, str] | None = None) -> str:
    """The system message of a check."""
    task, schema = TASKS[check]
    lines = [task, "", "Guidelines:", *(f"- {k}: {v}" for k, v in guidelines.items())]
    if examples:
        lines += ["", "Examples:", *(f"- {a} -> {b}" for a, b in examples.items())]
    return "\n".join([*lines, "", RULES, answer_form(schema)])


def requests(elements: DataFrame, check: str, guidelines: Mapping[str, str], model: str, text: str = "text", examples: Mapping[str, str] | None = None) -> DataFrame:
    """elements with check and payload. Elements whose text is null or blank are not asked about: they have no rows."""
    t: Column = strip(F.coalesce(F.col(text), F.lit("")))
    return elements.filter(t != "").select("*", F.lit(check).alias("check"), chat_payload(F.lit(prompt(check, guidelines, examples)), t, model).alias("payload"))


def findings(asked: DataFrame, responses: DataFrame, check: str, keys: list[str]) -> DataFrame:
    """One row per object of the answers to a check: keys, pos, and the fields of its answer. Requests without a response, and objects that
    cannot be read, have no rows."""
    schema = TASKS[check][1]
    met = asked.filter(F.col("check") == check).select(*keys, "check").join(responses.select(*keys, "check", "response"), [*keys, "check"])
    rows = parse_objects(met.select(*keys, "response"), "response", schema)
    return rows.filter("parsed IS NOT NULL").select(*keys, "pos", "parsed.*")
