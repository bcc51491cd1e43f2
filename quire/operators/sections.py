"""From marks to the section tree, its duplicates, and the fixed-schema document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quire.functions.text import let
from quire.operators.duplicates import settle_duplicates
from quire.operators.headings import screened
from quire.operators.marks import WARNING, with_marks
from quire.sources.text_reader import read_blocks, text_tasks

# Fixed values.
ELEMENTS = [
    "Title", "Authors' names", "Authors' affiliations", "Corresponding author's address", "Abstract", "Text", "Acknowledgments", "CRediT Author Statement", "References", "Figure legends", "Tables",
    "Appendixes", "Figures", "other",
]
ELEMENT_OF = {
    "Title": "title", "Authors' names": "authors authors_marker", "Authors' affiliations": "affiliations", "Corresponding author's address": "correspondence", "Abstract": "abstract",
    "Text": "introduction objectives methods results results_and_discussion discussion limitations conclusions implications recommendations future_work related_work study_sample measures "
    "statistical_analysis framework procedures other_heading",
    "Acknowledgments": "acknowledgments funding declaration_of_interest disclaimer presented_at", "CRediT Author Statement": "credit_statement", "References": "references",
    "Figure legends": "figure_legends", "Tables": "tables_section", "Appendixes": "appendix supplementary",
}
UNLABELED = ("unlabeled", "front_other")
#: Codes of warnings: of reading, of the marks, and of the finished tree.
WARNINGS = ("repeated-headers", "references-without-entries", "weak-label-ignored", "no-title", "no-references", "unlabeled-spans")
IMRAD_ORDER = {"introduction": 0.0, "objectives": 1.0, "methods": 2.0, "results": 3.0, "results_and_discussion": 3.5, "discussion": 4.0, "limitations": 5.0, "conclusions": 6.0}


def standard_element(section_type: Column) -> Column:
    out = F.lit("other")
    for element, types in ELEMENT_OF.items():
        out = F.when(section_type.isin(types.split()), element).otherwise(out)
    return F.when(section_type.startswith("abstract_"), "Abstract").otherwise(out)


def tree(marks: DataFrame) -> DataFrame:
    """Adds id, parent_id and next_block (the block of the next mark of the same or a higher level, null at the end).

    The parent is the latest earlier mark of a lower level number; a section ends before the next mark that is not below it."""
    doc = Window.partitionBy("doc_id").orderBy("idx", "level")
    out = marks.withColumn("id", F.row_number().over(doc))
    before, after = doc.rowsBetween(Window.unboundedPreceding, -1), doc.rowsBetween(1, Window.unboundedFollowing)
    parent, nxt = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k in (1, 2, 3):
        parent = F.when(F.col("level") == k, F.last(F.when(F.col("level") < k, F.col("id")), ignorenulls=True).over(before)).otherwise(parent)
        nxt = F.when(F.col("level") == k, F.first(F.when(F.col("level") <= k, F.col("idx")), ignorenulls=True).over(after)).otherwise(nxt)
    return out.select("*", parent.alias("parent_id"), nxt.alias("next_block"))


def sequence_bonus() -> Column:
    """0.05 for the top-level IMRaD sections of a document that has three or more, all in order."""
    order = F.lit(None).cast("double")
    for t, v in IMRAD_ORDER.items():
        order = F.when(F.col("section_type") == t, v).otherwise(order)
    order = F.when(F.col("level") == 1, order)
    doc = Window.partitionBy("doc_id")
    seen = F.transform(F.array_sort(F.collect_list(F.when(order.isNotNull(), F.struct(F.col("id").alias("i"), order.alias("o")))).over(doc)), lambda x: x["o"])
    steady = (F.size(seen) >= 3) & (seen == F.array_sort(seen))
    return F.when(order.isNotNull() & steady, 0.05).otherwise(0.0)


def _tree_in_row(m: Column) -> Column:
    """The tree of an array of marks in (idx, level) order: adds id, parent_id and next_block, as tree() does over rows."""
    def place(x: Column, i: Column) -> Column:
        above = F.array_max(F.transform(F.slice(m, F.lit(1), i), lambda y, j: F.when(y["level"] < x["level"], j + 1)))
        after = F.array_min(F.transform(F.slice(m, i + 2, F.size(m)), lambda y: F.when(y["level"] <= x["level"], y["idx"])))
        return F.struct(x.alias("m"), (i + 1).alias("id"), above.alias("parent_id"), after.alias("next_block"))

    return F.transform(m, place)


def _order(section_type: Column, level: Column) -> Column:
    out = F.lit(None).cast("double")
    for t, v in IMRAD_ORDER.items():
        out = F.when((section_type == t) & (level == 1), v).otherwise(out)
    return out


def section_arrays(marked: DataFrame) -> DataFrame:
    """marked: with_marks() with text, start and end kept. doc_id and sections (an array, in order)."""
    by_place = F.array_sort("marks", lambda a, b: F.when((a["idx"] < b["idx"]) | ((a["idx"] == b["idx"]) & (a["level"] < b["level"])), -1).when((a["idx"] == b["idx"]) & (a["level"] == b["level"]), 0).otherwise(1))
    orders = lambda marks: F.filter(F.transform(marks, lambda m: _order(m["section_type"], m["level"])), lambda o: o.isNotNull())
    steady = lambda seen: (F.size(seen) >= 3) & (seen == F.array_sort(seen))
    # let(): what the lambdas below use must be computed once per document, not once per section.
    doc = let(by_place, lambda m: F.struct(
        F.array_join("blocks.text", "\n").alias("full_text"), F.col("blocks.start").alias("starts"), F.col("blocks.end").alias("ends"), _tree_in_row(m).alias("tree"), let(orders(m), steady).alias("steady")))

    def section(d: Column, x: Column) -> Column:
        m = x["m"]
        end_block = F.greatest(m["idx"], F.coalesce(x["next_block"], F.size(d["starts"])) - 1)
        start, end = F.get(d["starts"], m["idx"]), F.get(d["ends"], end_block)
        base = F.greatest(F.lit(0.15), F.least(F.lit(0.97), m["conf"]))
        sure = F.when(_order(m["section_type"], m["level"]).isNotNull() & d["steady"], F.least(F.lit(0.97), base + 0.05)).otherwise(base)
        return F.struct(x["id"].alias("id"), x["parent_id"].alias("parent_id"), m["section_type"].alias("section_type"), m["name"].alias("name"), m["level"].alias("level"), m["idx"].alias("start_block"), end_block.alias("end_block"),
                        start.alias("start_position"), end.alias("end_position"), F.substr(d["full_text"], start + 1, end - start).alias("extracted_text"), sure.alias("confidence"), m["evidence"].alias("evidence"), m["flags"].alias("flags"))

    made = let(doc, lambda d: F.transform(d["tree"], lambda x: section(d, x)))
    return marked.select("doc_id", made.alias("sections"), *[c for c in ("warnings",) if c in marked.columns])


def add_duplicates(sections: DataFrame) -> DataFrame:
    """The same for sections in rows (doc_id and a section's columns)."""
    names = ("id", "parent_id", "section_type", "name", "level", "start_block", "end_block", "start_position", "end_position", "extracted_text", "confidence", "evidence", "flags")
    docs = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*names[:-1]))).alias("s"), F.map_from_entries(F.collect_list(F.struct("id", "flags"))).alias("f"))
    with_flags = F.transform("s", lambda x: F.struct(*[x[n].alias(n) for n in names[:-1]], F.try_element_at("f", x["id"]).alias("flags")))
    return in_rows(settle_duplicates(docs.select("doc_id", with_flags.alias("sections"))))


def in_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode("sections").alias("s")).select("doc_id", "s.*")


def extract_sections(docs: DataFrame, doc_id: str = "doc_id", raw: str = "raw") -> DataFrame:
    """Text documents to their section trees."""
    return in_rows(read_sections(docs, doc_id, raw))


def read_sections(docs: DataFrame, doc_id: str = "doc_id", raw: str = "raw") -> DataFrame:
    """sections_in_documents() of text documents, in tasks of a bounded number of characters."""
    tasks = text_tasks(docs, raw)
    return sections_in_documents(read_blocks(docs, doc_id, raw, tasks), text_mode=True, tasks=tasks)


def sections_in_documents(blocks: DataFrame, text_mode: bool, tasks: int | None = None) -> DataFrame:
    """Blocks to doc_id, sections and warnings (array of WARNING). Blocks meet once by document; the tree, its texts and its duplicates are
    made within that row.

    Warnings tell of a references heading without entries, of weak labels that were passed over, of a missing title or missing references,
    and of how many sections were left unlabeled."""
    marked = with_marks(screened(blocks, text_mode), keep=("text", "start", "end"), tasks=tasks)
    return with_unlabeled(settle_duplicates(section_arrays(marked)))


def with_unlabeled(docs: DataFrame) -> DataFrame:
    """Adds to the warnings how many sections have no type, if any."""
    n = F.size(F.filter("sections", lambda s: s["section_type"].isin(*UNLABELED)))
    return docs.withColumn("warnings", F.concat("warnings", F.when(n > 0, F.array(warning("unlabeled-spans", n))).otherwise(F.array().cast(f"array<{WARNING}>"))))


def warning(code: str, count: Column) -> Column:
    """A warning of the whole document."""
    return F.struct(F.lit(code), F.lit(None).cast("int"), count.cast("int")).cast(WARNING)


def observed(docs: DataFrame) -> tuple[DataFrame, Observation]:
    """docs (with warnings) and what is counted of them while an action computes them: documents, documents with warnings, and for each code
    the sum of its counts. It costs no pass of its own, and no shuffle."""
    seen = Observation()
    total = lambda code: F.coalesce(F.sum(F.aggregate(F.filter("warnings", lambda w: w["code"] == code), F.lit(0).cast("bigint"), lambda a, w: a + w["count"])), F.lit(0))
    return docs.observe(seen, F.count(F.lit(1)).alias("documents"), F.count(F.when(F.size("warnings") > 0, 1)).alias("with-warnings"), *[total(c).alias(c) for c in WARNINGS]), seen


def sections_of_blocks(blocks: DataFrame, text_mode: bool) -> DataFrame:
    return in_rows(sections_in_documents(blocks, text_mode))


def section_records(sections: DataFrame) -> DataFrame:
    """Sections as reported: standard element and a rounded confidence."""
    return sections.select("*", standard_element(F.col("section_type")).alias("standard_element")).withColumn("confidence", F.bround("confidence", 3))


ROLLED = ("start_position", "id", "level", "section_type", "end_position", "extracted_text", "duplicate_of", "evidence")


def similarity_of(evidence: Column) -> Column:
    """The similarity that a section's evidence tells, of the last comparison; null without one."""
    said = F.filter(evidence, lambda e: e.contains("similarity="))
    return F.regexp_extract(F.try_element_at(said, F.lit(-1)), r"similarity=([\d.]+)", 1).try_cast("double")


def standard_documents(sections: DataFrame) -> DataFrame:
    """document_elements() of sections in rows."""
    return document_elements(sections.groupBy("doc_id").agg(F.collect_list(F.struct(*ROLLED)).alias("sections")))


def extract_documents(docs: DataFrame, doc_id: str = "doc_id", raw: str = "raw") -> DataFrame:
    """Text documents to document_elements(). Sections stay within their document's row, so there is no second shuffle."""
    return document_elements(read_sections(docs, doc_id, raw))


def document_elements(docs: DataFrame) -> DataFrame:
    """docs: doc_id and sections. One row per document with every standard element: texts of its top-level sections that are no
    duplicates, in order, with a blank line between; '' if there are none. Also the spans of each element and the list of duplicates."""
    picked = lambda on, names: F.array_sort(F.transform(F.filter("sections", on), lambda s: F.struct(*[(standard_element(s["section_type"]) if n == "element" else similarity_of(s["evidence"]) if n == "similarity" else s[n]).alias(n) for n in names])))
    kept = picked(lambda s: (s["level"] == 1) & s["duplicate_of"].isNull(), ("start_position", "id", "element", "end_position", "extracted_text"))
    dup = picked(lambda s: s["duplicate_of"].isNotNull(), ("id", "element", "section_type", "start_position", "end_position", "duplicate_of", "similarity"))
    g = docs.select("doc_id", kept.alias("k"), dup.alias("duplicates"))
    parts = lambda e: F.filter("k", lambda x: x["element"] == e)
    texts = [F.array_join(F.transform(parts(e), lambda x: x["extracted_text"]), "\n\n").alias(e) for e in ELEMENTS]
    spans = F.map_from_arrays(F.array(*[F.lit(e) for e in ELEMENTS]), F.array(*[F.transform(parts(e), lambda x: F.array(x["start_position"], x["end_position"])) for e in ELEMENTS]))
    return g.select("doc_id", *texts, "duplicates", spans.alias("element_spans"))


def document_records(docs: DataFrame, streams: DataFrame) -> DataFrame:
    """docs: doc_id, sections and warnings. streams: doc_id, stream, text. One row per document with both: excluded_streams is a map from
    stream to its texts, in order of text, without streams that have none. Lines that were left out as repeated headers and footers are
    told as the first warning."""
    per = streams.groupBy("doc_id", "stream").agg(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.col("text")))).alias("texts")).filter(F.size("texts") > 0)
    maps = per.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("stream", "texts"))).alias("excluded_streams"))
    out = docs.join(maps, "doc_id", "left").withColumn("excluded_streams", F.coalesce("excluded_streams", F.create_map().cast("map<string,array<string>>")))
    n = F.size(F.try_element_at("excluded_streams", F.lit("headers_footers")))
    return out.withColumn("warnings", F.when(n > 0, F.concat(F.array(warning("repeated-headers", n)), F.col("warnings"))).otherwise(F.col("warnings")))


def span_styles(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """blocks x spans (doc_id, span_start, span_end): each block a span touches, with its runs clipped to the span."""
    b = blocks.join(spans, "doc_id").filter((F.col("end") > F.col("span_start")) & (F.col("start") < F.col("span_end")))
    runs = b.select("*", F.posexplode("runs").alias("run", "r"))
    at = Window.partitionBy("doc_id", "span_start", "span_end", "idx").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("run_start", F.col("start") + F.coalesce(F.sum(F.length("r.text")).over(at), F.lit(0)))
    runs = runs.withColumn("run_end", F.col("run_start") + F.length("r.text")).filter((F.col("run_end") > F.col("span_start")) & (F.col("run_start") < F.col("span_end")))
    low, high = F.greatest("run_start", "span_start"), F.least("run_end", "span_end")
    return runs.select(
        "doc_id", "span_start", "span_end", "idx", "run", low.alias("start_char"), high.alias("end_char"), F.substr("r.text", low - F.col("run_start") + 1, high - low).alias("text"),
        F.struct(*[F.col("r." + n).alias(n) for n in ("font_name", "font_size", "bold", "italic", "underline", "strike", "color", "highlight", "vert_align", "caps")]).alias("style"),
    )


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Neighbouring runs of one block and one style become one range."""
    w = Window.partitionBy("doc_id", "span_start", "span_end").orderBy("idx", "run")
    new = F.coalesce(~((F.lag("idx").over(w) == F.col("idx")) & F.lag(F.to_json("style")).over(w).eqNullSafe(F.to_json("style"))), F.lit(True))
    parts = ranges.withColumn("__new", new.cast("int")).withColumn("range", F.sum("__new").over(w))
    g = parts.groupBy("doc_id", "span_start", "span_end", "range").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), F.array_sort(F.collect_list(F.struct("idx", "run", "text"))).alias("t"), F.first("style").alias("style"))
    return g.select("doc_id", "span_start", "span_end", "range", "start_char", "end_char", F.array_join("t.text", "").alias("text"), "style")
