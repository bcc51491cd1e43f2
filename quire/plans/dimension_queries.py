"""The fixed lists of the engine, applied to the documents, against lists that are stated here on their own."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import lexicon as lx
from quire.functions import prompts, titles
from quire.functions import text as tx
from quire.functions.citations import format_numbers
from quire.operators import duplicates, element_checks, marks, sections
from quire.plans.pattern_queries import cases
from quire.plans.registry import derived, query
from quire.plans.text_queries import HEADINGS
from quire.sources import docx


#: What is no word of a list, after A-Z are lower-cased.
BETWEEN = "[^a-z0-9☐☑☒]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DOCUMENTS = f"d AS (SELECT ' ' || regexp_replace(translate(text, '{UPPER}', '{UPPER.lower()}'), '{BETWEEN}', ' ', 'g') || ' ' AS t FROM documents)"


def phrase(word: str) -> str:
    """A word, name or type as it stands in a document's normal form."""
    return f" {re.sub(BETWEEN, ' ', word.lower())} "


def counted(spark: SparkSession, sf_dir: str, words: list[str]) -> DataFrame:
    """word, documents: in how many documents each of a list's words is. One pass and one row, whatever the number of documents."""
    text = F.concat(F.lit(" "), F.regexp_replace(F.translate("text", UPPER, UPPER.lower()), BETWEEN, " "), F.lit(" ")).alias("t")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(text)
    sums = [F.count_if(F.col("t").contains(phrase(w))).alias(f"n{k}") for k, w in enumerate(words)]
    pairs = [F.struct(F.lit(w).alias("word"), F.col(f"n{k}").alias("documents")) for k, w in enumerate(words)]
    return rows.agg(*sums).select(F.inline(F.array(*pairs)))


def listed(name: str, expected: str, of) -> None:
    """Registers a query of (list, word, documents): which lists there are, and in how many documents each word is.
    expected: "list: word, word. list: ..."; of(): a dict of lists."""
    pairs = [(part.split(":")[0].strip(), w.strip()) for part in expected.split(".") if ":" in part for w in part.split(":")[1].split(",")]

    values = ", ".join("('{}', '{}', '{}')".format(a, *(x.replace("'", "''") for x in (b, phrase(b)))) for a, b in pairs)

    @query(name, f"WITH {DOCUMENTS} SELECT list, word, count(t) AS documents FROM (VALUES {values}) AS v(list, word, phrase) LEFT JOIN d ON contains(t, phrase) GROUP BY list, word")
    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        lists = {a: [str(w) for w in words] for a, words in of().items()}
        lists_of = spark.createDataFrame([(a, w) for a, words in lists.items() for w in words], "list string, word string")
        return lists_of.join(counted(spark, sf_dir, sorted({w for words in lists.values() for w in words})), "word").select("list", "word", "documents")


@derived("dim_01_vocabulary", HEADINGS, "SELECT is_subsection, names, types, (SELECT count(*) FROM i WHERE k % 11 < 10 AND (k % 11 = 4) = is_subsection) AS headings FROM (VALUES (false, 274::BIGINT, 37::BIGINT), (true, 49::BIGINT, 5::BIGINT)) AS t(is_subsection, names, types)")
def vocabulary(i):
    """Names and types of sections and subsections, and how many headings have one of the names."""
    found = lx.add_match(i, F.col("heading"), "m").groupBy(F.col("m.variant").alias("variant")).agg(F.count("*").alias("n"))
    return lx.lexicon(i.sparkSession).join(found, "variant", "left").groupBy("is_subsection").agg(
        F.countDistinct("variant").alias("names"), F.countDistinct("section_type").alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("headings"))


# Fixed values, stated apart from the code that holds them.
listed("dim_02_families", """
    imrad: introduction, objectives, methods, results, discussion, conclusions, limitations, results_and_discussion.
    tail: figure_legends, tables_section, appendix, supplementary.
    subsections: study_sample, measures, statistical_analysis, framework, procedures.
    back: acknowledgments, funding, declaration_of_interest, disclaimer, presented_at, data_availability, ethics, credit_statement, abbreviations.
""", lambda: {"imrad": lx.IMRAD, "tail": lx.TAIL, "subsections": lx.SUBSECTIONS, "back": lx.BACK})
listed("dim_03_label_words", """
    introduction: introduction, background. objectives: rationale, objective, objectives, purpose, aim, aims. methods: method, methods, materials and methods.
    results: result, results, findings. discussion: discussion. conclusions: conclusion, conclusions. limitations: limitations.
""", lambda: {t: [w for w, x in marks.LABEL_TYPES.items() if x == t] for t in set(marks.LABEL_TYPES.values())})
listed("dim_04_heading_stop_words", "stop: a, an, and, the, of, in, on, for, to, with, by, at, or, vs, via, from, as, its.", lambda: {"stop": tx.STOP_WORDS})
listed("dim_05_title_stop_words", """
    small: a, an, the, and, or, nor, but, as, at, by, for, from, in, into, of, on, onto, per, to, up, via, with, without.
    abbreviations: THE, AND, FOR, WITH, FROM, THIS, THAT, TABLE, FIGURE, RESULTS, METHODS, INTRODUCTION, DISCUSSION, CONCLUSION, ABSTRACT, KEYWORDS, CI.
""", lambda: {"small": titles.SMALL_WORDS, "abbreviations": titles.ABBREVIATION_STOP - {"E.G."}})
listed("dim_06_word_classes", "conjunctions: and, but, or, nor, for, yet, so.", lambda: {"conjunctions": titles.CONJUNCTIONS})
listed("dim_08_duplicate_types", """
    single: acknowledgments, credit_statement, data_availability, declaration_of_interest, ethics, funding. boxes: ☐, ☑, ☒.
    compared: abstract, acknowledgments, affiliations, authors, conclusions, correspondence, credit_statement, data_availability, declaration_of_interest, disclaimer, discussion, front_metadata, funding,
    future_work, highlights, implications, introduction, keywords, limitations, methods, objectives, orcid, recommendations, related_work, results, results_and_discussion, running_head, title, title_page_marker.
""", lambda: {"single": duplicates.SINGLE_TYPES, "boxes": duplicates.CHECKBOXES, "compared": duplicates.COMPARED_TYPES})
listed("dim_11_rule_sets", """
    title: title_form_constraint, title_hyphenation_constraint, subtitle_placement_and_separator. authors: academic_degree, affiliation_sequence, working_group.
    correspondence: start_constraint, degrees_constraint, email_constraint, abbreviation_constraint, phone_constraint, fax_constraint, title_constraint, end_constraint.
    acknowledgments: start_constraint, sections_constraint, end_constraint. credit: start_constraint, fullname_constraint, role_constraint, format_constraint.
""", lambda: {e: [g for x, g, _ in element_checks.RULES if x == e] for e in dict.fromkeys(x for x, _, _ in element_checks.RULES)})
listed("dim_14_rich_keys", "rich: font, size, u, strike, color, highlight, valign. plain: bold, italic, caps.", lambda: {"rich": docx.RICH, "plain": docx.PLAIN})
listed("dim_15_response_fields", """
    edit: guideline_followed, guideline_id, reason, affected_text, suggested_replacement, edit_score. term: term, valid_abbreviation, expanded_form, equivalent_in_common_list. part: section, text.
""", lambda: {n: [f.split()[0] for f in s.split(", ")] for n, s in (("edit", prompts.EDIT), ("term", prompts.TERM), ("part", prompts.PART))})


@query("dim_09_order_numbers", "SELECT * FROM (VALUES ('introduction', 0.0), ('objectives', 1.0), ('methods', 2.0), ('results', 3.0), ('results_and_discussion', 3.5), ('discussion', 4.0), ('limitations', 5.0), ('conclusions', 6.0)) AS t(section_type, place)".replace("SELECT *", f"WITH {DOCUMENTS} SELECT section_type, place::DOUBLE AS place, (SELECT count(*) FROM d WHERE contains(t, ' ' || replace(section_type, '_', ' ') || ' ')) AS documents"))
def order_numbers(spark, sf_dir):
    places = spark.createDataFrame(list(sections.IMRAD_ORDER.items()), "section_type string, place double")
    return places.join(counted(spark, sf_dir, list(sections.IMRAD_ORDER)).withColumnRenamed("word", "section_type"), "section_type")


STATEMENTS = "SELECT c_custkey AS k, 'credit' AS element, 'CRediT Author Statement' || chr(10) || 'Jane Doe: ' || CASE c_custkey % 4 WHEN 0 THEN 'Software, Writing - review & editing.' WHEN 1 THEN 'Formal analysis, Resources' WHEN 2 THEN 'software' ELSE 'Coffee, Supervision' END AS text FROM {customer} UNION ALL SELECT c_custkey, 'acknowledgments', 'ACKNOWLEDGMENTS' || chr(10) || CASE c_custkey % 3 WHEN 0 THEN 'Disclaimers: x Funding: y Declaration of interest: z' WHEN 1 THEN 'Funding: y Disclaimers: x Declaration of interest: z' ELSE 'Presented at: a' END FROM {customer}"


@derived("dim_12_roles_and_parts", STATEMENTS, "SELECT k, guideline, CASE guideline WHEN 'role_constraint' THEN k % 4 < 2 ELSE k % 3 <> 1 END AS followed FROM i JOIN (VALUES ('credit', 'role_constraint'), ('acknowledgments', 'sections_constraint')) AS g(e, guideline) ON element = e")
def roles_and_parts(i):
    return element_checks.check_elements(i).filter(F.col("guideline_id").isin("role_constraint", "sections_constraint")).select("k", F.col("guideline_id").alias("guideline"), "followed")


def _year(c: Column) -> Column:
    part = lambda v, n: (F.lit(v) if isinstance(v, str) else v).alias(n)
    return format_numbers(F.struct(part(c, "year"), part("1", "volume"), part("", "issue"), part("", "pages"), part("", "article_number")))


cases("dim_13_years", [("'20 Mar 1850'", "1850;1"), ("'May 2199 x'", "2199;1"), ("'in 1799'", "None;1"), ("'2200 May'", "None;1"), ("'12020 May'", "None;1"), ("'2020'", "2020;1")], "shown", "VARCHAR", _year)


REPEATED = "SELECT n_nationkey AS doc_id, 'INTRODUCTION' || chr(10) || chr(10) || repeat('abcd ', 10) || n_name || chr(10) || chr(10) || 'METHODS' || chr(10) || chr(10) || 'Other words of it.' || chr(10) || chr(10) || 'INTRODUCTION' || chr(10) || chr(10) || repeat('abcd ', 10) || n_name AS raw FROM {nation}"


@derived("rx_27_similarity_in_evidence", REPEATED, "SELECT doc_id, 3::INT AS id, 1.0::DOUBLE AS similarity FROM i")
def similarity_in_evidence(i):
    d = sections.extract_documents(i)
    return d.select("doc_id", F.explode("duplicates").alias("d")).select("doc_id", "d.id", "d.similarity")
