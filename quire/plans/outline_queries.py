"""Manuscripts that try the order-dependent rules, three or more to each rule: the whole section tree of every document is compared.

A document is a list of blocks with a blank line between; which one a nation gets follows from its number. What is expected are all its
sections in order: type, level, first and last block, confidence, and where they have one the section that they are in or that they repeat
(as).
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quire.operators import sections
from quire.plans.registry import derived

TITLE = "'The Long Study of Nation ' || n_name"
PROSE = "'We asked ' || n_nationkey || ' people about it, and they told us what they knew in some detail.'"
OTHER = "'Some other words that are not at all like those above: a list of ' || n_nationkey || ' items follows, with no more.'"
LONG = "'It is known to all of us that much has been said of nation ' || n_nationkey || ', and that more will be said of it in times to come, by those who live there and by those who only read of it in books of many kinds and sizes.'"
REF1, REF2, REF3 = "1. Doe J. First part. J Test. 2019;5(2):11-19.", "2. Roe K. Second part. J Test. 2020;6(1):21-29.", "3. Poe L. Third part. J Test. 2021;7(3):31-39."
BYLINE = "Jane Q. Doe, MD, PhD, John Roe, MPH, Ann Poe, PhD"
SECTION = re.compile(r"(\w+) (\d) (\d+)-(\d+) ([\d.]+)(?: in (\d+))?(?: as (\d+))?")


def outlines(name: str, documents: list[tuple[list[str], str]]) -> None:
    """Registers a query: the sections of the documents, all of them."""
    text = lambda b: b if "||" in b or b.startswith("'") else "'" + b.replace("'", "''") + "'"
    raw = "CASE n_nationkey % " + str(len(documents)) + " " + " ".join(f"WHEN {k} THEN " + " || chr(10) || chr(10) || ".join(map(text, blocks)) for k, (blocks, _) in enumerate(documents)) + " END"
    rows = []
    for k, (_, expected) in enumerate(documents):
        for i, part in enumerate(expected.split("; "), 1):
            kind, level, first, last, conf, parent, dup = SECTION.fullmatch(part).groups("NULL")
            rows.append(f"({k}, {i}, '{kind}', {level}, {first}, {last}, {parent}, {dup}, {conf})")
    oracle = f"""SELECT doc_id, id::INT AS id, section_type, level::INT AS level, start_block::INT AS start_block, end_block::INT AS end_block, parent_id::INT AS parent_id, duplicate_of::INT AS duplicate_of, confidence::DOUBLE AS confidence
      FROM i JOIN (VALUES {", ".join(rows)}) AS e(v, id, section_type, level, start_block, end_block, parent_id, duplicate_of, confidence) ON doc_id % {len(documents)} = v"""

    @derived(name, f"SELECT n_nationkey AS doc_id, {raw} AS raw FROM {{nation}}", oracle)
    def found(i):
        s = sections.section_records(sections.extract_sections(i))
        return s.select("doc_id", "id", "section_type", "level", "start_block", "end_block", "parent_id", "duplicate_of", F.col("confidence").cast("double").alias("confidence"))


BODY = ["INTRODUCTION", PROSE, "METHODS", OTHER]
DOCS: dict[str, list[tuple[list[str], str]]] = {
    "rule_06_unheaded_references": [
        ([TITLE, *BODY, REF1, REF2, REF3, REF1, REF2],  # a run of five in the last part
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9; references 1 5-9 0.6"),
        ([TITLE, *BODY, REF1, REF2, REF3, REF1],  # four are too few
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-8 0.9"),
        ([REF1, REF2, REF3, REF1, REF2, TITLE, *BODY, OTHER, OTHER, PROSE, LONG],  # a run at the start
         "title 1 0-0 0.6; front_other 1 1-2 0.4; title 1 3-3 0.65 as 1; front_other 1 4-5 0.4; introduction 1 6-7 0.9; methods 1 8-13 0.9"),
        ([TITLE, *BODY, "REFERENCES", "no entries here, but a line of words"],  # a heading without entries
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9; references 1 5-5 0.6; unlabeled 1 6-6 0.3"),
        ([TITLE, *BODY, "REFERENCES", REF1, REF2, "DISCUSSION", PROSE, "REFERENCES", REF1, REF3],  # the last one with entries
         "title 1 0-0 0.6; introduction 1 1-2 0.95; methods 1 3-4 0.95; references 1 5-7 0.9; discussion 1 8-9 0.95; references 1 10-12 0.95"),
    ],
    "rule_07_label_scan": [
        ([TITLE, "ABSTRACT", "Introduction: we looked at many things in many lands for long.", "Methods: we asked very many people about these many things.", "Results: they knew some of it but by far not all of these.", *BODY],
         "title 1 0-0 0.6; abstract 1 1-4 0.9; abstract_introduction 2 2-2 0.7 in 2; abstract_methods 2 3-3 0.7 in 2; abstract_results 2 4-4 0.7 in 2; introduction 1 5-6 0.9; methods 1 7-8 0.9"),
        ([TITLE, "ABSTRACT", "Introduction", "we looked at things", "Methods", "we asked very many people about these things, and wrote it down", *BODY],  # labels alone take one short line
         "title 1 0-0 0.6; abstract 1 1-5 0.9; abstract_introduction 2 2-3 0.75 in 2; abstract_methods 2 4-5 0.75 in 2; introduction 1 6-7 0.9; methods 1 8-9 0.9"),
        ([TITLE, "ABSTRACT", "IntroductionWe looked at many things in many lands for long.", "Results On average they knew a half of it, and we the rest.", *BODY],  # glued
         "title 1 0-0 0.6; abstract 1 1-3 0.9; abstract_introduction 2 2-2 0.8 in 2; abstract_results 2 3-3 0.8 in 2; introduction 1 4-5 0.9; methods 1 6-7 0.9"),
        ([TITLE, "ABSTRACT", "Introduction: we looked at many things in many lands for long.", "- a bullet ends it", "Methods: we asked very many people about these many things.", *BODY],
         "title 1 0-0 0.6; abstract 1 1-4 0.9; abstract_introduction 2 2-3 0.7 in 2; abstract_methods 2 4-4 0.7 in 2; introduction 1 5-6 0.9; methods 1 7-8 0.9"),
        ([TITLE, "ABSTRACT", "Introduction: we looked at many things in many lands for long.", "Introduction: we looked again at many things in many lands.", "Methods: we asked very many people about these many things.", *BODY],  # a label counts once
         "title 1 0-0 0.6; abstract 1 1-4 0.9; abstract_introduction 2 2-4 0.7 in 2; introduction 1 5-6 0.9; methods 1 7-8 0.9"),
    ],
    "rule_08_structured_abstract": [
        ([TITLE, "ABSTRACT", PROSE, *BODY, "RESULTS", PROSE],
         "title 1 0-0 0.6; abstract 1 1-2 0.9; introduction 1 3-4 0.95; methods 1 5-6 0.95; results 1 7-8 0.95"),
        ([TITLE, "Background: it was known to us all before we began with it.", "Methods: we asked very many people about these many things.", "Results: they knew some of it but by far not all of these.", "INTRODUCTION", PROSE, "METHODS", OTHER, "RESULTS", LONG],  # a cluster without heading
         "title 1 0-0 0.6; abstract 1 1-3 0.85; abstract_introduction 2 1-1 0.7 in 2; abstract_methods 2 2-2 0.7 in 2; abstract_results 2 3-3 0.7 in 2; introduction 1 4-5 0.95; methods 1 6-7 0.95; results 1 8-9 0.95"),
        ([TITLE, "ABSTRACT", PROSE, "INTRODUCTION", OTHER, "METHODS", LONG, "ABSTRACT", PROSE],  # a second abstract
         "title 1 0-0 0.6; abstract 1 1-2 0.9; introduction 1 3-4 0.9; methods 1 5-6 0.9; abstract 1 7-8 0.75 as 2"),
        ([TITLE, "Abstract (250 words)", PROSE, *BODY],
         "title 1 0-0 0.6; abstract 1 1-2 0.85; introduction 1 3-4 0.9; methods 1 5-6 0.9"),
    ],
    "rule_09_keywords": [
        ([TITLE, "ABSTRACT", PROSE, "Keywords: size; brand; type of part", *BODY],
         "title 1 0-0 0.6; abstract 1 1-2 0.9; keywords 1 3-3 0.85; introduction 1 4-5 0.9; methods 1 6-7 0.9"),
        ([TITLE, "KEYWORDS", "size; brand; type", "- part", *BODY],  # a list
         "title 1 0-0 0.6; keywords 1 1-1 0.9; front_other 1 2-3 0.4; introduction 1 4-5 0.9; methods 1 6-7 0.9"),
        ([TITLE, "HIGHLIGHTS", "- We found one thing", "- We found another", "Not a bullet. But two sentences. Of no great length.", *BODY],
         "title 1 0-0 0.6; highlights 1 1-3 0.9; front_other 1 4-4 0.4; introduction 1 5-6 0.9; methods 1 7-8 0.9"),
        ([TITLE, "Keywords: size", LONG, *BODY],  # text after the keywords
         "title 1 0-0 0.6; keywords 1 1-1 0.85; unlabeled 1 2-2 0.3; introduction 1 3-4 0.9; methods 1 5-6 0.9"),
    ],
    "rule_10_repeated_body_type": [
        ([TITLE, "INTRODUCTION", PROSE, "RESULTS", PROSE, "METHODS", OTHER, "RESULTS", LONG, "REFERENCES", REF1, REF2],
         "title 1 0-0 0.6; introduction 1 1-2 0.9; results 1 3-4 0.9; methods 1 5-6 0.9; results 1 7-8 0.75; references 1 9-11 0.95"),
        ([TITLE, "INTRODUCTION", PROSE, "METHODS", OTHER, "RESULTS", LONG, "LIMITATIONS", PROSE, "DISCUSSION", OTHER],
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9; results 1 5-6 0.9; limitations 1 7-8 0.9; discussion 1 9-10 0.9"),
        ([TITLE, "INTRODUCTION", PROSE, "METHODS", "Study sample", OTHER, "Statistical analysis", LONG, "RESULTS", PROSE],  # subsections
         "title 1 0-0 0.6; introduction 1 1-2 0.95; methods 1 3-7 0.95; study_sample 2 4-5 0.75 in 3; statistical_analysis 2 6-7 0.75 in 3; results 1 8-9 0.95"),
        ([TITLE, "INTRODUCTION", PROSE, "DISCUSSION", OTHER, "Limitations", LONG, "SUMMARY", PROSE],  # weaker than the core; summary by position
         "title 1 0-0 0.6; introduction 1 1-2 0.9; discussion 1 3-6 0.9; limitations 2 5-6 0.75 in 3; summary 1 7-8 0.9"),
        ([TITLE, "INTRODUCTION", PROSE, "SPECIAL WORDS OF OURS", OTHER, "Conclusions", LONG],  # an unknown heading
         "title 1 0-0 0.6; introduction 1 1-2 0.9; other_heading 1 3-4 0.65; conclusions 1 5-6 0.75"),
    ],
    "rule_11_tail_groups": [
        ([TITLE, *BODY, "REFERENCES", REF1, REF2, "Figure 1. The people", "Figure 2. The lands", "Table 1. The sizes", "Appendix Table 1. More"],
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9; references 1 5-7 0.95; figure_legends 1 8-9 0.75; tables_section 1 10-10 0.75; appendix 1 11-11 0.75"),
        ([TITLE, *BODY, "REFERENCES", REF1, REF2, "FIGURE LEGENDS", "Figure 1. The people", "APPENDIX", PROSE],
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9; references 1 5-7 0.95; figure_legends 1 8-9 0.9; appendix 1 10-11 0.9"),
        ([TITLE, *BODY, "REFERENCES", REF1, REF2, PROSE, "Table 1. The sizes", "Journal: of things"],
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9; references 1 5-7 0.95; unlabeled 1 8-8 0.3; tables_section 1 9-9 0.75; unlabeled 1 10-10 0.3"),
        ([TITLE, *BODY, "REFERENCES", REF1, REF2, "BMI: body mass index", "Supplementary Figure 1. More"],
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9; references 1 5-8 0.95; appendix 1 9-9 0.75"),
    ],
    "join_16_fuzzy_tail_heading": [
        ([TITLE, *BODY, "REFERENCES", REF1, REF2, "IST OF FIGURES", "Figure 1. The people"],
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9; references 1 5-7 0.95; figure_legends 1 8-9 0.65"),
        ([TITLE, *BODY, "REFERENCES", REF1, REF2, "GIST OF IT ALL", "Figure 1. The people"],
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9; references 1 5-7 0.95; other_heading 1 8-8 0.65; figure_legends 1 9-9 0.75"),
        ([TITLE, *BODY, "REFERENCES", REF1, REF2, "list of tabels", "Table 1. The sizes"],  # a line before a group of captions
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9; references 1 5-7 0.95; tables_section 1 8-9 0.7"),
    ],
    "rule_12_front_matter": [
        ([TITLE, BYLINE, "From the Department of Things, University of Nation", "Corresponding to: Jane Doe", "Phone: 12345", *BODY],
         "title 1 0-0 0.6; authors 1 1-1 0.85; affiliations 1 2-2 0.85; correspondence 1 3-4 0.8; introduction 1 5-6 0.9; methods 1 7-8 0.9"),
        ([TITLE, "RUNNING HEAD: THINGS", "Word count: 2500", "0000-0002-1825-0097", "a line of front matter that fits nothing", *BODY],
         "title 1 0-0 0.6; running_head 1 1-1 0.85; front_metadata 1 2-2 0.85; orcid 1 3-3 0.85; front_other 1 4-4 0.4; introduction 1 5-6 0.9; methods 1 7-8 0.9"),
        (["Title: The Study of Nation by Number", BYLINE, "ACKNOWLEDGMENTS", "We thank you all.", *BODY],  # a label; a statement in front
         "title 1 0-0 0.9; authors 1 1-1 0.85; acknowledgments 1 2-2 0.9; front_other 1 3-3 0.4; introduction 1 4-5 0.9; methods 1 6-7 0.9"),
        ([TITLE, LONG, BYLINE, *BODY],  # prose without heading
         "title 1 0-0 0.6; unlabeled 1 1-1 0.3; authors 1 2-2 0.85; introduction 1 3-4 0.9; methods 1 5-6 0.9"),
        ([BYLINE, "Corresponding to: Jane Doe", "University Hospital of Nation", "1 Main Street, Madison, WI, USA me@uni.edu", *BODY],  # lines under the correspondence
         "authors 1 0-0 0.85; correspondence 1 1-3 0.8; introduction 1 4-5 0.9; methods 1 6-7 0.9"),
    ],
    "join_17_repeated_title": [
        ([TITLE, BYLINE, TITLE, *BODY],
         "title 1 0-0 0.6; authors 1 1-1 0.85; title 1 2-2 0.65 as 1; introduction 1 3-4 0.9; methods 1 5-6 0.9"),
        ([TITLE, BYLINE, "'The Long Study of Nation ' || n_name || '.'", *BODY],
         "title 1 0-0 0.6; authors 1 1-1 0.85; title 1 2-2 0.65 as 1; introduction 1 3-4 0.9; methods 1 5-6 0.9"),
        ([TITLE, BYLINE, "The Short Tale of Another Land", *BODY],
         "title 1 0-0 0.6; authors 1 1-1 0.85; front_other 1 2-2 0.4; introduction 1 3-4 0.9; methods 1 5-6 0.9"),
    ],
    "rule_15_singleton_restatement": [
        ([TITLE, "INTRODUCTION", PROSE, "FUNDING", "The study was paid for by the nation of which we speak here.", "METHODS", "'We asked people about it in many ways. ' || repeat('We asked and asked. ', 120)", "DISCUSSION", OTHER, "FUNDING", "Zebra quartz jumps vex the lazy dogs of it.", "REFERENCES", REF1, REF2],
         "title 1 0-0 0.6; introduction 1 1-2 0.95; funding 1 3-4 0.9; methods 1 5-6 0.95; discussion 1 7-8 0.95; funding 1 9-10 0.75 as 3; references 1 11-13 0.95"),
        ([TITLE, "INTRODUCTION", PROSE, "FUNDING", "The study was paid for by the nation of which we speak here.", "METHODS", OTHER, "FUNDING", "None.", "REFERENCES", REF1, REF2],  # a stub
         "title 1 0-0 0.6; introduction 1 1-2 0.9; funding 1 3-4 0.9; methods 1 5-6 0.9; funding 1 7-8 0.75 as 3; references 1 9-11 0.95"),
        ([TITLE, "INTRODUCTION", PROSE, "ETHICS", "☐ We have asked for it in writing, and it was given to us.", "METHODS", OTHER, "ETHICS", "The board of the nation has seen the plan and let us go on.", "REFERENCES", REF1, REF2],  # check boxes
         "title 1 0-0 0.6; introduction 1 1-2 0.9; ethics 1 3-4 0.75 as 5; methods 1 5-6 0.9; ethics 1 7-8 0.9; references 1 9-11 0.95"),
        ([TITLE, "INTRODUCTION", PROSE, "ETHICS", "The board has seen it and let us go on.", "METHODS", OTHER, "ETHICS", "Zebra quartz jumps vex the lazy dogs of it.", "REFERENCES", REF1, REF2],  # neither
         "title 1 0-0 0.6; introduction 1 1-2 0.9; ethics 1 3-4 0.9; methods 1 5-6 0.9; ethics 1 7-8 0.9; references 1 9-11 0.95"),
    ],
    "win_11_contributor_lines": [
        ([TITLE, *BODY, "Jane Doe: Writing, Software", "John Roe: Supervision", "Ann Poe: Validation, Resources", "REFERENCES", REF1, REF2],
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9; credit_statement 1 5-7 0.7; references 1 8-10 0.95"),
        ([TITLE, *BODY, "Jane Doe: Writing, Software", "John Roe: Supervision", "REFERENCES", REF1, REF2],  # two are too few
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-6 0.9; references 1 7-9 0.95"),
        ([TITLE, *BODY, "CREDIT AUTHOR STATEMENT", "Jane Doe: Writing, Software", "John Roe: Supervision", "Ann Poe: Validation, Resources", "REFERENCES", REF1, REF2],  # headed
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9; credit_statement 1 5-8 0.9; references 1 9-11 0.95"),
    ],
    "win_09_reference_end": [
        ([TITLE, *BODY, "REFERENCES", REF1, OTHER, REF2, PROSE, OTHER, REF3, PROSE],  # one block between is allowed, two are not
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9; references 1 5-8 0.95; unlabeled 1 9-12 0.3"),
        ([TITLE, *BODY, "REFERENCES", REF1, BYLINE, "Phone: 12345", REF2, PROSE],  # two that are stray front matter are
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9; references 1 5-9 0.95; unlabeled 1 10-10 0.3"),
        ([TITLE, *BODY, "REFERENCES", REF1, REF2, "Table 1. The sizes", REF3],  # captions end it
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9; references 1 5-7 0.95; tables_section 1 8-9 0.75"),
    ],
    "agg_06_reference_lookahead": [
        ([TITLE, *BODY, "REFERENCES", REF1, "DISCUSSION", PROSE],  # one of seven
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9; references 1 5-6 0.6; unlabeled 1 7-8 0.3"),
        ([TITLE, *BODY, "REFERENCES", OTHER, PROSE, OTHER, PROSE, OTHER, REF1, REF2],  # two of seven
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9; references 1 5-5 0.95; unlabeled 1 6-12 0.3"),
        ([TITLE, *BODY, "REFERENCES", OTHER, PROSE, OTHER, PROSE, OTHER, PROSE, REF1, REF2],  # one of seven, one after
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9; references 1 5-5 0.6; unlabeled 1 6-13 0.3"),
    ],
    "agg_07_distinct_families": [
        ([TITLE, "Background: it was known to us all before we began with it.", "Methods: we asked very many people about these many things.", "Results: they knew some of it but by far not all of these.", PROSE, "Acknowledgments", PROSE, "DISCUSSION", OTHER],  # three families
         "title 1 0-0 0.6; front_other 1 1-4 0.4; acknowledgments 1 5-5 0.75; front_other 1 6-6 0.4; discussion 1 7-8 0.9"),
        ([TITLE, "Background: it was known to us all before we began with it.", "Methods: we asked very many people about these many things.", PROSE, "DISCUSSION", OTHER],  # two
         "title 1 0-0 0.6; front_other 1 1-3 0.4; discussion 1 4-5 0.9"),
        ([TITLE, "ABSTRACT", "Background: it was known to us all before we began with it.", PROSE, "DISCUSSION", OTHER],  # one under a heading
         "title 1 0-0 0.6; abstract 1 1-3 0.9; abstract_introduction 2 2-3 0.7 in 2; discussion 1 4-5 0.9"),
    ],
    "agg_08_strongest_core": [
        ([TITLE, "INTRODUCTION", PROSE, "Limitations", OTHER, "METHODS", LONG],
         "title 1 0-0 0.6; introduction 1 1-4 0.9; limitations 2 3-4 0.75 in 2; methods 1 5-6 0.9"),
        ([TITLE, "Introduction", PROSE, "Limitations", OTHER, "Methods", LONG],
         "title 1 0-0 0.6; introduction 1 1-2 0.75; limitations 1 3-4 0.75; methods 1 5-6 0.75"),
        ([TITLE, "Introduction", PROSE, "LIMITATIONS", OTHER, "Methods", LONG],
         "title 1 0-0 0.6; front_other 1 1-2 0.4; limitations 1 3-4 0.9; methods 1 5-6 0.75"),
    ],
    "agg_09_unlabeled_spans": [
        (["a plain line at the start of it all", LONG, *BODY],
         "title 1 0-0 0.6; unlabeled 1 1-1 0.3; introduction 1 2-3 0.9; methods 1 4-5 0.9"),
        ([TITLE, *BODY, "REFERENCES", REF1, REF2, "and here is a line after them that nothing names"],
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9; references 1 5-7 0.95; unlabeled 1 8-8 0.3"),
        (["no structure here at all", "nor here"],
         "title 1 0-0 0.6; front_other 1 1-1 0.4"),
        ([TITLE, *BODY],
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9"),
    ],
    "agg_10_repeated_types": [
        ([TITLE, "INTRODUCTION", PROSE, "METHODS", OTHER, "INTRODUCTION", PROSE],  # the same text again
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9; introduction 1 5-6 0.6 as 2"),
        ([TITLE, "INTRODUCTION", PROSE, "METHODS", OTHER, "INTRODUCTION", LONG],
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9; introduction 1 5-6 0.75"),
        ([TITLE, "INTRODUCTION", PROSE, "METHODS", OTHER, "INTRODUCTION", "'" + "We asked ' || n_nationkey || ' people about it, and they told us what they knew in some detail. And then some more was said, which makes this one much longer.'"],  # contained, and longer
         "title 1 0-0 0.6; introduction 1 1-2 0.75 as 4; methods 1 3-4 0.9; introduction 1 5-6 0.75"),
    ],
    "agg_11_composite_argmin": [
        ([TITLE, "INTRODUCTION", PROSE, "ETHICS", "☐ ☑ We have asked for it in writing.", "METHODS", OTHER, "ETHICS", "Short.", "REFERENCES", REF1, REF2],  # boxes come first
         "title 1 0-0 0.6; introduction 1 1-2 0.9; ethics 1 3-4 0.75 as 5; methods 1 5-6 0.9; ethics 1 7-8 0.9; references 1 9-11 0.95"),
        ([TITLE, "INTRODUCTION", PROSE, "ETHICS", "The board has seen it.", "METHODS", OTHER, "ETHICS", "Quartz.", "REFERENCES", REF1, REF2],  # then the longer
         "title 1 0-0 0.6; introduction 1 1-2 0.9; ethics 1 3-4 0.9; methods 1 5-6 0.9; ethics 1 7-8 0.75 as 3; references 1 9-11 0.95"),
        ([TITLE, "INTRODUCTION", PROSE, "ACKNOWLEDGMENTS", "We thank you all for it.", "Funding: None of it.", "METHODS", OTHER, "FUNDING", "Quartz.", "REFERENCES", REF1, REF2],  # nested before that
         "title 1 0-0 0.6; introduction 1 1-2 0.9; acknowledgments 1 3-5 0.9; funding 2 5-5 0.7 in 3; methods 1 6-7 0.9; funding 1 8-9 0.75 as 4; references 1 10-12 0.95"),
    ],
    "join_08_section_pairs": [
        ([TITLE, "INTRODUCTION", PROSE, "METHODS", PROSE, "RESULTS", PROSE],  # different types are no pair
         "title 1 0-0 0.6; introduction 1 1-2 0.95; methods 1 3-4 0.95; results 1 5-6 0.95"),
        ([TITLE, "ABSTRACT", PROSE, "INTRODUCTION", OTHER, "METHODS", LONG, "ABSTRACT", PROSE, "ABSTRACT", PROSE],  # a chain
         "title 1 0-0 0.6; abstract 1 1-2 0.9; introduction 1 3-4 0.9; methods 1 5-6 0.9; abstract 1 7-8 0.75 as 2; abstract 1 9-10 0.75 as 2"),
        ([TITLE, "INTRODUCTION", "Short.", "METHODS", OTHER, "INTRODUCTION", "Short."],
         "title 1 0-0 0.6; introduction 1 1-2 0.9; methods 1 3-4 0.9; introduction 1 5-6 0.6 as 2"),
    ],
    "join_14_eligible_blocks": [
        ([TITLE, "KEYWORDS", "size; brand", "type; part", BYLINE, *BODY],  # what belongs to keywords is no front matter
         "title 1 0-0 0.6; keywords 1 1-3 0.9; authors 1 4-4 0.85; introduction 1 5-6 0.9; methods 1 7-8 0.9"),
        ([TITLE, BYLINE, "ABSTRACT", PROSE, *BODY],
         "title 1 0-0 0.6; authors 1 1-1 0.85; abstract 1 2-3 0.9; introduction 1 4-5 0.9; methods 1 6-7 0.9"),
        ([TITLE, "ABSTRACT", PROSE, OTHER, "Keywords: size", BYLINE, *BODY],
         "title 1 0-0 0.6; abstract 1 1-3 0.9; keywords 1 4-4 0.85; authors 1 5-5 0.85; introduction 1 6-7 0.9; methods 1 8-9 0.9"),
    ],
    "sort_09_candidate_picks": [
        ([TITLE, *BODY, "REFERENCES", REF1, REF2, "DISCUSSION", PROSE, "REFERENCES", REF1, REF3, "REFERENCES", PROSE],  # the last heading with entries
         "title 1 0-0 0.6; introduction 1 1-2 0.95; methods 1 3-4 0.95; references 1 5-7 0.9; discussion 1 8-9 0.95; references 1 10-12 0.95; unlabeled 1 13-14 0.3"),
        ([TITLE, "Introduction", PROSE, "METHODS", OTHER],  # the first strong heading starts the body
         "title 1 0-0 0.6; front_other 1 1-2 0.4; methods 1 3-4 0.9"),
        ([TITLE, "Introduction", PROSE, "Methods", OTHER],  # without a strong one, the first
         "title 1 0-0 0.6; introduction 1 1-2 0.75; methods 1 3-4 0.75"),
    ],
    "set_04_families_left": [
        ([TITLE, "ABSTRACT", "METHODS: WE ASKED MANY PEOPLE ABOUT MANY THINGS HERE.", "Methods: we asked very many people about these many things.", "Results: they knew some of it but by far not all of these.", *BODY],
         "title 1 0-0 0.6; abstract 1 1-4 0.9; abstract_methods 2 2-4 0.7 in 2; introduction 1 5-6 0.9; methods 1 7-8 0.9"),
        ([TITLE, "ABSTRACT", "Introduction: we looked at many things in many lands for long.", "Results: they knew some of it but by far not all of these.", "INTRODUCTION", PROSE],
         "title 1 0-0 0.6; abstract 1 1-3 0.9; abstract_introduction 2 2-2 0.7 in 2; abstract_results 2 3-3 0.7 in 2; introduction 1 4-5 0.9"),
        ([TITLE, "ABSTRACT", "Purpose: we looked at many things in many lands for long.", "Aims: they knew some of it but by far not all of these.", *BODY],
         "title 1 0-0 0.6; abstract 1 1-3 0.9; abstract_objectives 2 2-3 0.7 in 2; introduction 1 4-5 0.9; methods 1 6-7 0.9"),
    ],
    "set_06_mark_sources": [
        ([TITLE, BYLINE, "ABSTRACT", PROSE, "Keywords: size", *BODY, "REFERENCES", REF1, REF2, "Figure 1. The people"],  # every source
         "title 1 0-0 0.6; authors 1 1-1 0.85; abstract 1 2-3 0.9; keywords 1 4-4 0.85; introduction 1 5-6 0.9; methods 1 7-8 0.9; references 1 9-11 0.95; figure_legends 1 12-12 0.75"),
        ([TITLE, "Keywords: size", *BODY],
         "title 1 0-0 0.6; keywords 1 1-1 0.85; introduction 1 2-3 0.9; methods 1 4-5 0.9"),
        ([*BODY],
         "introduction 1 0-1 0.9; methods 1 2-3 0.9"),
    ],
    "win_06_section_ends": [
        ([TITLE, "INTRODUCTION", PROSE, "METHODS", OTHER, "Study sample", LONG, "Measures", PROSE, "RESULTS", OTHER],
         "title 1 0-0 0.6; introduction 1 1-2 0.95; methods 1 3-8 0.95; study_sample 2 5-6 0.75 in 3; measures 2 7-8 0.75 in 3; results 1 9-10 0.95"),
        ([TITLE, "INTRODUCTION", PROSE, "Study sample", OTHER, "Statistical analysis", LONG],
         "title 1 0-0 0.6; introduction 1 1-6 0.9; study_sample 2 3-4 0.75 in 2; statistical_analysis 2 5-6 0.75 in 2"),
        ([TITLE, "METHODS", "Study sample", "Measures", "RESULTS", PROSE],  # without text between
         "title 1 0-0 0.6; methods 1 1-3 0.9; study_sample 2 2-2 0.75 in 2; measures 2 3-3 0.75 in 2; results 1 4-5 0.9"),
    ],
    "win_08_section_numbers": [
        ([TITLE, "ABSTRACT", "Introduction: we looked at many things in many lands for long.", "Methods: we asked very many people about these many things.", "INTRODUCTION", PROSE, "METHODS", "Study sample", OTHER],
         "title 1 0-0 0.6; abstract 1 1-3 0.9; abstract_introduction 2 2-2 0.7 in 2; abstract_methods 2 3-3 0.7 in 2; introduction 1 4-5 0.9; methods 1 6-8 0.9; study_sample 2 7-8 0.75 in 6"),
        ([TITLE, "INTRODUCTION", PROSE, "ACKNOWLEDGMENTS", OTHER, "Funding: None of it.", "METHODS", LONG],
         "title 1 0-0 0.6; introduction 1 1-2 0.9; acknowledgments 1 3-5 0.9; funding 2 5-5 0.7 in 3; methods 1 6-7 0.9"),
        (["INTRODUCTION", PROSE],
         "introduction 1 0-1 0.9"),
    ],
}

for _name, _documents in DOCS.items():
    outlines(_name, _documents)


# What a document's record warns of: code, block where there is one, and count. Every part has a document.
WARNED: list[tuple[list[str], str]] = [
    (["no structure here at all", "nor here"], "no-references::1|unlabeled-spans::1"),
    ([TITLE, *BODY], "no-references::1"),
    ([TITLE, *BODY, "REFERENCES", "no entries here, but a line of words"], "references-without-entries:5:1|unlabeled-spans::1"),
    ([TITLE, *BODY, "REFERENCES", REF1, REF2], ""),
    (["a plain line at the start of it all", LONG, *BODY, "REFERENCES", REF1, REF2, "and here is a line after them that nothing names"], "unlabeled-spans::2"),
    ([BYLINE, *BODY], "no-references::1|no-title::1"),
    ([TITLE, "INTRODUCTION", PROSE, "Results: they knew some of it but by far not all of these.", "METHODS", OTHER, "RESULTS", PROSE], "no-references::1|weak-label-ignored:3:1"),
]
_WARNED_SQL = "SELECT p_partkey AS doc_id, CASE p_partkey % " + str(len(WARNED)) + " " + " ".join(
    f"WHEN {k} THEN " + " || chr(10) || chr(10) || ".join((b if "||" in b or b.startswith("'") else "'" + b + "'").replace("n_name", "p_name").replace("n_nationkey", "p_partkey") for b in blocks) for k, (blocks, _) in enumerate(WARNED)) + " END AS raw FROM {part}"


@derived("agg_09_unlabeled_warnings", _WARNED_SQL, f"""SELECT doc_id, w AS warnings, coalesce(nullif(regexp_extract(w, 'unlabeled-spans::([0-9]+)', 1), ''), '0')::INT AS unlabeled
  FROM i JOIN (VALUES {", ".join(f"({k}, '{w}')" for k, (_, w) in enumerate(WARNED))}) AS e(v, w) ON doc_id % {len(WARNED)} = v""", dealt=True)
def unlabeled_warnings(i):
    docs = sections.read_sections(i)
    said = F.transform("warnings", lambda w: F.concat(w["code"], F.lit(":"), F.coalesce(w["block"].cast("string"), F.lit("")), F.lit(":"), w["count"].cast("string")))
    unlabeled = F.aggregate(F.filter("warnings", lambda w: w["code"] == "unlabeled-spans"), F.lit(0), lambda a, w: a + w["count"])
    return docs.select("doc_id", F.array_join(F.array_sort(said), "|").alias("warnings"), unlabeled.alias("unlabeled"))
