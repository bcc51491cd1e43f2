"""Rules for headings: typography, hierarchy, order; and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import is_all_caps, is_headline_case, is_sentence_case, lines, list_to_string, normalize_font_name, normalize_name, strip

# Fixed values.
HEADER_FONT = "Franklin Gothic Medium"
STYLE_WINDOW = 500
HIERARCHY = [
    ("INTRODUCTION", 1, None), ("METHODS", 1, None), ("STUDY SAMPLE", 2, "METHODS"), ("STUDY POPULATION", 2, "METHODS"), ("MEASURES", 2, "METHODS"), ("STATISTICAL ANALYSIS", 2, "METHODS"),
    ("RESULTS", 1, None), ("DISCUSSION", 1, None), ("LIMITATIONS", 2, "DISCUSSION"), ("CONCLUSIONS", 1, None),
]
ORDER = ["INTRODUCTION", "METHODS", "RESULTS", "DISCUSSION", "CONCLUSIONS"]
GUIDELINES = [
    ("h1_all_caps", "H1-01", "Heading must be all caps", "Heading is not written in all caps"),
    ("h1_font_name", "H1-02", "Font must be 'Franklin Gothic Medium'", "Font is not 'Franklin Gothic Medium'"),
    ("h1_font_size", "H1-03", "Font size must be 14 pt", "Font size is not 14 pt"),
    ("h1_bold", "H1-04", "Font must be bold", "Font is not bold"),
    ("h1_not_italic", "H1-05", "Font must not be italic", "Font is italic"),
    ("h2_headline_case", "H2-01", "Heading must use headline case", "Heading is not written in headline case"),
    ("h2_font_name", "H2-02", "Font must be 'Franklin Gothic Medium'", "Font is not 'Franklin Gothic Medium'"),
    ("h2_font_size", "H2-03", "Font size must be 11 pt", "Font size is not 11 pt"),
    ("h2_bold", "H2-04", "Font must be bold", "Font is not bold"),
    ("h2_not_italic", "H2-05", "Font must not be italic", "Font is italic"),
    ("h3_sentence_case", "H3-01", "Heading must use sentence case", "Heading is not written in sentence case"),
    ("h3_final_period", "H3-02", "Heading must end with a period", "Heading does not end with a period"),
    ("h3_font_name", "H3-03", "Font must match the body text font", "Heading font does not match the body text font"),
    ("h3_font_size", "H3-04", "Font size must match the body text font size", "Heading font size does not match the body text font size"),
    ("h3_bold", "H3-05", "Font must be bold", "Font is not bold"),
    ("h3_not_italic", "H3-06", "Font must not be italic", "Font is italic"),
    ("h4_sentence_case", "H4-01", "Heading must use sentence case", "Heading is not written in sentence case"),
    ("h4_final_period", "H4-02", "Heading must end with a period", "Heading does not end with a period"),
    ("h4_font_name", "H4-03", "Font must match the body text font", "Heading font does not match the body text font"),
    ("h4_font_size", "H4-04", "Font size must match the body text font size", "Heading font size does not match the body text font size"),
    ("h4_bold", "H4-05", "Font must be bold", "Font is not bold"),
    ("h4_italic", "H4-06", "Font must be italic", "Font is not italic"),
    ("correct_level", "HIER-01", "Section must have the correct hierarchy level", "Section has an incorrect hierarchy level"),
    ("correct_parent", "HIER-02", "Section must have the correct parent section", "Section has an incorrect parent section"),
    ("contains_introduction", "ORD-01", "Document must contain an Introduction section", "Introduction section is missing"),
    ("contains_methods", "ORD-02", "Document must contain a Methods section", "Methods section is missing"),
    ("contains_results", "ORD-03", "Document must contain a Results section", "Results section is missing"),
    ("contains_discussion", "ORD-04", "Document must contain a Discussion section", "Discussion section is missing"),
    ("contains_conclusions", "ORD-05", "Document must contain a Conclusions section", "Conclusions section is missing"),
    ("correct_top_level_order", "ORD-06", "Top-level sections must appear in the required order", "Top-level sections are not in the required order"),
    ("no_unexpected_top_level_sections", "ORD-07", "Document must not contain unexpected top-level sections", "Unexpected top-level section detected"),
]
STYLE = "struct<font_name:string,font_size:double,bold:boolean,italic:boolean,underline:string,strike:boolean,color:string,highlight:string,vert_align:string,all_caps:boolean>"
RANGE = f"struct<text:string,style:{STYLE},paragraph_break:boolean>"
NONE = "array<string>"


def guidelines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *g) for i, g in enumerate(GUIDELINES)], "ord int, key string, id string, guideline string, reason string")


def hierarchy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HIERARCHY, "norm_name string, expected_level int, expected_parent string")


def text_runs(ranges: Column) -> Column:
    """Ranges with a style that are no paragraph breaks."""
    return F.filter(ranges, lambda r: ~F.coalesce(r["paragraph_break"], F.lit(False)) & (r["text"] != "\n") & r["style"].isNotNull())


def body_style(ranges: Column) -> Column:
    """The style of the first styled range after the first paragraph break; null without one."""
    at = F.array_position(F.transform(ranges, lambda r: F.coalesce(r["paragraph_break"], F.lit(False))), True).cast("int")
    after = F.filter(F.slice(ranges, F.greatest(at, F.lit(1)), F.size(ranges)), lambda r: ~F.coalesce(r["paragraph_break"], F.lit(False)) & r["style"].isNotNull())
    return F.when(at > 0, F.get(after, F.lit(0))["style"])


def _sorted(checks: list[tuple[str, Column, str, Column]]) -> tuple[Column, Column, Column]:
    """checks: key, holds, kind (style or text), applies. Passed keys, failed style keys, failed text keys, in order."""
    pick = lambda want, kinds: F.array_compact(F.array(*[F.when(a & (h if want else ~h), F.lit(k)) for k, h, kind, a in checks if kind in kinds]))
    return pick(True, ("style", "text")), pick(False, ("style",)), pick(False, ("text",))


def add_style_checks(sections: DataFrame) -> DataFrame:
    """sections: level, name, extracted_text, ranges (array of RANGE from the section's start). Adds heading_text, style_followed,
    style_issues, text_issues and actual_style.

    Levels 1 to 4 have five or six rules each; those that compare with the body are left out where no body style is found."""
    df = sections.withColumn("__runs", text_runs(F.col("ranges"))).withColumn("__body", body_style(F.col("ranges")))
    first_line = strip(F.coalesce(F.get(lines(F.coalesce("extracted_text", F.lit(""))), F.lit(0)), F.lit("")))
    df = df.withColumn("__none", F.size("__runs") == 0).withColumn("__s", F.get("__runs", F.lit(0))["style"])
    df = df.withColumn("heading_text", F.when(~F.col("__none") & (first_line != ""), first_line).otherwise(strip(F.coalesce("name", F.lit("")))))
    s, h, body = F.col("__s"), F.col("heading_text"), F.col("__body")
    yes = lambda c: F.coalesce(c, F.lit(False))
    bold, italic = yes(s["bold"]), yes(s["italic"])
    font = normalize_font_name(s["font_name"]) == HEADER_FONT.lower()
    same_font = normalize_font_name(s["font_name"]) == normalize_font_name(body["font_name"])
    same_size = s["font_size"].eqNullSafe(body["font_size"])
    checks = []
    for n, case, size in ((1, ("h1_all_caps", is_all_caps(h)), 14), (2, ("h2_headline_case", is_headline_case(h)), 11)):
        on = yes(F.col("level") == n)
        checks += [(case[0], case[1], "text", on), (f"h{n}_font_name", font, "style", on), (f"h{n}_font_size", yes(s["font_size"] == size), "style", on), (f"h{n}_bold", bold, "style", on), (f"h{n}_not_italic", ~italic, "style", on)]
    for n in (3, 4):
        on = yes(F.col("level") == n)
        slanted = ("h3_not_italic", ~italic) if n == 3 else ("h4_italic", italic)
        checks += [(f"h{n}_sentence_case", is_sentence_case(h), "text", on), (f"h{n}_final_period", h.endswith("."), "text", on), (f"h{n}_bold", bold, "style", on), (*slanted, "style", on)]
        checks += [(f"h{n}_font_name", same_font, "style", on & body.isNotNull()), (f"h{n}_font_size", same_size, "style", on & body.isNotNull())]
    followed, style, text = _sorted(checks)
    none = F.array().cast(NONE)
    other = F.when(F.coalesce(F.col("level").isin(1, 2, 3, 4), F.lit(False)), style).otherwise(F.array(F.concat(F.lit("Unsupported heading level: "), F.coalesce(F.col("level").cast("string"), F.lit("None")))))
    df = df.withColumn("style_followed", F.when(F.col("__none"), none).otherwise(followed)).withColumn("style_issues", F.when(F.col("__none"), F.array(F.lit("no_styled_text"))).otherwise(other))
    df = df.withColumn("text_issues", F.when(F.col("__none"), F.array(F.lit("no_heading_text"))).otherwise(text)).withColumn("actual_style", F.when(~F.col("__none"), s))
    return df.drop("__runs", "__body", "__none", "__s")


def check_hierarchy(sections: DataFrame) -> DataFrame:
    """doc_id, id, hierarchy_followed, hierarchy_issues: level and parent of each section against the expected hierarchy.

    Joins: the expected hierarchy (of fixed size), the section's parent, and the last section that has the expected parent's name."""
    spark = sections.sparkSession
    s = sections.select("doc_id", "id", "parent_id", "level", "name", normalize_name(F.col("name")).alias("norm_name"))
    named = s.filter("norm_name <> ''").groupBy("doc_id", F.col("norm_name").alias("expected_parent")).agg(F.max_by("id", "id").alias("wanted_id"))
    parents = s.select("doc_id", F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    j = s.join(F.broadcast(hierarchy(spark)), "norm_name", "left").join(named, ["doc_id", "expected_parent"], "left").join(parents, ["doc_id", "parent_id"], "left")
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    found = F.coalesce("parent_name", F.concat(F.lit("id="), shown(F.col("parent_id"))))
    level_ok = F.coalesce(F.col("level") == F.col("expected_level"), F.lit(False))
    top = F.col("expected_parent").isNull()
    parent_ok = F.when(top, F.col("parent_id").isNull()).otherwise(F.coalesce(F.col("parent_id") == F.col("wanted_id"), F.lit(False)))
    issue = (
        F.when(top, F.format_string("Expected parent_id=None, found parent '%s' (id=%s)", found, shown(F.col("parent_id"))))
        .when(F.col("wanted_id").isNull(), F.format_string("Expected parent '%s' does not exist", F.col("expected_parent")))
        .otherwise(F.format_string("Expected parent_id=%s ('%s'), found parent_id=%s ('%s')", shown(F.col("wanted_id")), F.col("expected_parent"), shown(F.col("parent_id")), found))
    )
    level_issue = F.format_string("Expected level %s, found level %s", shown(F.col("expected_level")), shown(F.col("level")))
    known = F.col("expected_level").isNotNull()
    followed = F.array_compact(F.array(F.when(known & level_ok, F.lit("correct_level")), F.when(known & parent_ok, F.lit("correct_parent"))))
    issues = F.when(~known, F.array(F.lit("Section is not defined in expected hierarchy"))).otherwise(F.array_compact(F.array(F.when(~level_ok, level_issue), F.when(~parent_ok, issue))))
    return j.select("doc_id", "id", followed.alias("hierarchy_followed"), issues.alias("hierarchy_issues"))


def check_order(sections: DataFrame, strict_order: bool = False) -> DataFrame:
    """doc_id, actual_order, followed, issues, valid: the top-level sections of each document.

    Without strict_order the order rule always passes, as it does in the documented behaviour; with it the order is really checked."""
    top = F.when(F.col("parent_id").isNull(), F.struct("start_position", "id", normalize_name(F.col("name")).alias("n")))
    g = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(top)).alias("t")).select("doc_id", F.col("t.n").alias("actual_order"))
    has = lambda n: F.array_contains("actual_order", n)
    expected = F.array(*[F.lit(n) for n in ORDER])
    present = F.array_intersect(expected, F.col("actual_order"))
    in_order = F.array_intersect(F.col("actual_order"), expected) == present if strict_order else F.lit(True)
    odd = F.filter("actual_order", lambda n: ~n.isin(ORDER))
    followed = F.array_compact(F.array(*[F.when(has(n), F.lit(f"contains_{n.lower()}")) for n in ORDER], F.when(in_order, F.lit("correct_top_level_order")), F.when(F.size(odd) == 0, F.lit("no_unexpected_top_level_sections"))))
    issues = F.array_compact(F.array(
        *[F.when(~has(n), F.lit(f"Missing top-level section '{n}'")) for n in ORDER], F.when(~in_order, F.lit("Top-level sections are not in expected order")),
        F.when(F.size(odd) > 0, F.concat(F.lit("Unexpected top-level sections: "), F.array_join(odd, ", ")))))
    return g.select("doc_id", "actual_order", followed.alias("followed"), issues.alias("issues")).withColumn("valid", F.size("issues") == 0)


def validate_sections(sections: DataFrame) -> DataFrame:
    """One row per section with its style, text and hierarchy results."""
    s = add_style_checks(sections).join(check_hierarchy(sections), ["doc_id", "id"], "left")
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    s = s.withColumn("hierarchy_followed", F.coalesce("hierarchy_followed", F.array().cast(NONE))).withColumn("hierarchy_issues", F.coalesce("hierarchy_issues", F.array(F.lit("Hierarchy result not found"))))
    s = s.withColumn("style_valid", empty("style_issues")).withColumn("text_valid", empty("text_issues")).withColumn("hierarchy_valid", empty("hierarchy_issues"))
    return s.withColumn("valid", F.col("style_valid") & F.col("text_valid") & F.col("hierarchy_valid"))


def validate_documents(validated: DataFrame, order: DataFrame) -> DataFrame:
    """doc_id and valid: order and every section."""
    all_ = validated.groupBy("doc_id").agg(F.bool_and("valid").alias("sections_valid"))
    return order.join(all_, "doc_id").select("doc_id", (F.col("valid") & F.col("sections_valid")).alias("valid"))


def report_csv(validated: DataFrame, order: DataFrame) -> DataFrame:
    """The flat report: a row per section, lists joined, document fields repeated."""
    docs = validate_documents(validated, order).withColumnRenamed("valid", "document_valid")
    o = order.select("doc_id", F.col("valid").alias("document_order_valid"), list_to_string(F.col("actual_order")).alias("actual_order"), F.lit(" | ".join(ORDER)).alias("expected_order"),
                     list_to_string(F.col("followed")).alias("document_order_followed"), list_to_string(F.col("issues")).alias("document_order_issues"))
    lists = [list_to_string(F.col(c)).alias(c) for c in ("text_issues", "style_followed", "style_issues", "hierarchy_followed", "hierarchy_issues")]
    style = [F.col("actual_style")[n].alias(n) for n in ("font_name", "font_size", "bold", "italic", "underline", "strike", "color", "highlight", "vert_align", "all_caps")]
    rows = validated.select("doc_id", F.col("id").alias("section_id"), "parent_id", F.col("name").alias("section_name"), "level", "heading_text", F.col("valid").alias("section_valid"), "text_valid", "style_valid", "hierarchy_valid", *lists, *style)
    return docs.join(o, "doc_id").join(rows, "doc_id")


def resolve_guidelines(rows: DataFrame, key: str = "key") -> DataFrame:
    """Adds guideline_id, guideline and reason: by key, else by a definition's text or reason (the first that has it), else the text
    itself."""
    dim = guidelines(rows.sparkSession)
    by_key = dim.select(F.col("key").alias("__k"), F.struct("id", "guideline", "reason").alias("__a"))
    texts = dim.select(F.explode(F.array(F.lower("guideline"), F.lower("reason"))).alias("__t"), F.col("ord"), F.struct("id", "guideline", "reason").alias("g"))
    by_text = texts.groupBy("__t").agg(F.min_by("g", "ord").alias("__b"))
    j = rows.join(F.broadcast(by_key), rows[key] == F.col("__k"), "left").join(F.broadcast(by_text), F.lower(strip(rows[key])) == F.col("__t"), "left")
    plain = F.struct(F.lit("").alias("id"), F.col(key).alias("guideline"), F.col(key).alias("reason"))
    g = F.coalesce("__a", "__b", plain)
    return j.select(*rows.columns, g["id"].alias("guideline_id"), g["guideline"].alias("guideline"), g["reason"].alias("reason"))


def guideline_rows(validated: DataFrame, order: DataFrame) -> DataFrame:
    """The guideline report: passed and failed rules of every section, then of the document's order; reason is '' where passed."""
    groups = [("style_followed", 1), ("style_issues", 0), ("text_issues", 0), ("hierarchy_followed", 1), ("hierarchy_issues", 0)]
    rows = None
    for k, (column, ok) in enumerate(groups):
        part = validated.select("doc_id", F.col("id").alias("section_ord"), F.lit(k).alias("group_ord"), F.posexplode(column).alias("pos", "key"), F.col("heading_text").alias("content"), F.col("name").alias("section")).withColumn("followed", F.lit(ok))
        rows = part if rows is None else rows.unionByName(part)
    for k, (column, ok) in enumerate((("followed", 1), ("issues", 0))):
        part = order.select("doc_id", F.lit(2147483647).alias("section_ord"), F.lit(k).alias("group_ord"), F.posexplode(column).alias("pos", "key"), F.lit("").alias("content"), F.lit("Document Order").alias("section"))
        rows = rows.unionByName(part.withColumn("followed", F.lit(ok)))
    out = resolve_guidelines(rows)
    return out.withColumn("reason", F.when(F.col("followed") == 1, "").otherwise(F.col("reason"))).drop("key")


def unique_sheet_names(docs: DataFrame, name: str = "name", order: str = "doc_id") -> DataFrame:
    """Adds sheet: the name cut to 31 characters, with _1, _2 ... where it was used before (upper and lower case count as equal)."""
    w = Window.partitionBy(F.lower(name)).orderBy(order)
    k = F.row_number().over(w) - 1
    suffix = F.concat(F.lit("_"), k.cast("string"))
    cut = F.substr(F.col(name), F.lit(1), F.lit(31) - F.length(suffix))
    return docs.withColumn("sheet", F.when(k == 0, F.col(name)).otherwise(F.concat(cut, suffix)))
