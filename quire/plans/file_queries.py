"""Queries over what is read from and written to files, and over providers and prompts. Files are made from the tables, in binary columns."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import prompts
from quire.functions import similarity as similarity_of_names
from quire.operators import duplicates
from quire.operators import element_checks as ec
from quire.plans.registry import derived, query, source
from quire.sources import docx, providers, workbook

NATIONS = "SELECT n_nationkey AS k, n_name AS name FROM {nation}"
T = lambda x, p="": f"<w:r>{'<w:rPr>' + p + '</w:rPr>' if p else ''}<w:t>{x}</w:t></w:r>"  # noqa: E731  a run


def made(i: DataFrame, build: Callable[[int, str], tuple[list, dict]], mode: str = "accept") -> DataFrame:
    """Documents of files that build(k, name) describes: k (as doc_id), blocks, excluded, warnings, error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = [docx.make_docx(*build(k, name)) for k, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files, pa.binary())], ["k", "content"])

    return docx.read_docx(i.select("k", "name").mapInArrow(run, "k int, content binary"), "k", mode=mode)


def blocks(documents: DataFrame) -> DataFrame:
    return docx.docx_blocks(documents).withColumnRenamed("doc_id", "k")


@derived("fn_65_run_text", NATIONS, "SELECT k, 'a' || chr(9) || name || '-x' AS text FROM i UNION ALL SELECT k, 'below' FROM i UNION ALL SELECT k, 'field 7 end' FROM i")
def run_text(i):
    """Tabs, breaks and hyphens are characters; field codes and drawings are not text."""
    def build(k, name):
        field = '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>PAGE</w:instrText></w:r><w:r><w:t>7</w:t><w:drawing><w:t>not this</w:t></w:drawing></w:r>'
        return [(f"<w:r><w:t>a</w:t><w:tab/><w:t>{name}</w:t><w:noBreakHyphen/><w:t>x</w:t><w:br/><w:t>below</w:t></w:r>", {}), (f"{T('field ')}{field}{T(' end')}", {})], {}

    return blocks(made(i, build)).select("k", "text")


_CHANGED = [("accept", "kept new moved in"), ("reject", "kept old moved out")]


@derived("fn_66_tracked_changes", NATIONS, "SELECT k, mode, text, 'unhandled elements: odd' AS warnings FROM i, (VALUES " + ", ".join(f"('{m}', '{t}')" for m, t in _CHANGED) + ") AS t(mode, text)")
def tracked_changes(i):
    """Both modes; containers are transparent; unknown elements are told."""
    def build(k, name):
        runs = [T("kept"), f"<w:hyperlink><w:ins>{T(' new')}</w:ins></w:hyperlink>", "<w:del><w:r><w:delText> old</w:delText></w:r></w:del>", f"<w:smartTag><w:moveTo>{T(' moved in')}</w:moveTo></w:smartTag>", f"<w:moveFrom>{T(' moved out')}</w:moveFrom>", "<w:odd/>", "<w:bookmarkStart/>"]
        return [("".join(runs), {})], {}

    both = [made(i, build, m).select(F.col("doc_id").alias("k"), F.lit(m).alias("mode"), F.col("blocks")[0]["text"].alias("text"), F.array_join("warnings", "|").alias("warnings")) for m, _ in _CHANGED]
    return both[0].unionByName(both[1])


@derived("fn_67_paragraphs_and_tables", NATIONS, """SELECT k, idx::INT AS idx, text, jc, is_list, is_table, page_break_before, outline::INT AS outline FROM (SELECT k, 0 AS idx, name AS text, 'center' AS jc, false AS is_list, false AS is_table, false AS page_break_before, 2 AS outline FROM i UNION ALL
  SELECT k, 1, 'item', '', true, false, true, NULL FROM i UNION ALL SELECT k, 2, 'a b' || chr(9) || name || chr(10) || 'c' || chr(9), NULL, false, true, false, NULL FROM i UNION ALL SELECT k, 3, 'in a box', '', false, false, false, NULL FROM i)""")
def paragraphs_and_tables(i):
    def build(k, name):
        cell = lambda *ps: "<w:tc>" + "".join(f"<w:p>{T(p) if p else ''}</w:p>" for p in ps) + "</w:tc>"
        return [
            (T(name), {"ppr": '<w:jc w:val="center"/><w:outlineLvl w:val="2"/>'}), (T("item"), {"ppr": "<w:pageBreakBefore/><w:numPr/>"}),
            (f"<w:tbl><w:tr>{cell('a', 'b')}{cell(name)}</w:tr><w:tr>{cell('c')}{cell('')}</w:tr></w:tbl>", {}), (f"<w:sdt><w:sdtContent>{T('in a box')}</w:sdtContent></w:sdt>", {}),
        ], {}

    return blocks(made(i, build)).select("k", "idx", "text", "jc", "is_list", "is_table", "page_break_before", "outline")


THEME = '<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:themeElements><a:fontScheme><a:majorFont><a:latin typeface="Major Face"/></a:majorFont><a:minorFont><a:latin typeface="Minor Face"/></a:minorFont></a:fontScheme></a:themeElements></a:theme>'
#: Run properties in XML, and font, size, underline, color, highlight and vertical alignment that they stand for.
_LOOKS = [
    ('<w:rFonts w:ascii="Arial" w:hAnsi="Other"/><w:sz w:val="21"/>', "Arial", 10.5, None, None, None, None), ('<w:rFonts w:hAnsi="Other"/><w:u w:val="double"/>', "Other", None, "double", None, None, None),
    ('<w:rFonts w:asciiTheme="minorHAnsi"/><w:u/>', "Minor Face", None, "single", None, None, None), ('<w:rFonts w:hAnsiTheme="majorBidi"/><w:color w:val="FF0000"/>', "Major Face", None, None, "FF0000", None, None),
    ('<w:u w:val="none"/><w:color w:val="auto"/><w:highlight w:val="none"/><w:vertAlign w:val="baseline"/>', None, None, None, None, None, None),
    ('<w:highlight w:val="yellow"/><w:vertAlign w:val="superscript"/><w:sz w:val="x"/>', None, None, None, None, "yellow", "superscript"),
]
_SQL = lambda v: "NULL" if v is None else repr(v)


@derived("fn_68_run_properties", NATIONS, "SELECT k, pos::INT AS pos, font_name::VARCHAR AS font_name, font_size::DOUBLE AS font_size, underline::VARCHAR AS underline, color::VARCHAR AS color, highlight::VARCHAR AS highlight, vert_align::VARCHAR AS vert_align FROM i, (VALUES "
         + ", ".join(f"({p}, {', '.join(map(_SQL, x[1:]))})" for p, x in enumerate(_LOOKS)) + ") AS t(pos, font_name, font_size, underline, color, highlight, vert_align)")
def run_properties(i):
    def build(k, name):
        return [("".join(T(f"{name}{p}", x[0]) for p, x in enumerate(_LOOKS)), {})], {"word/theme/theme1.xml": THEME}

    names = ("font_name", "font_size", "underline", "color", "highlight", "vert_align")
    return blocks(made(i, build)).select("k", F.posexplode("runs").alias("pos", "r")).select("k", "pos", *[F.col(f"r.{n}").alias(n) for n in names])


SHEET = """<w:styles XMLNS><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Default"/><w:sz w:val="20"/></w:rPr></w:rPrDefault></w:docDefaults>
<w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/><w:rPr><w:i/><w:sz w:val="22"/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="A"><w:name w:val="alpha"/><w:basedOn w:val="B"/><w:rPr><w:b w:val="0"/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="B"><w:name w:val="beta"/><w:basedOn w:val="A"/><w:rPr><w:b/><w:caps/><w:rFonts w:ascii="Beta"/></w:rPr><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style>
<w:style w:type="character" w:styleId="C"><w:rPr><w:strike/><w:b/></w:rPr></w:style></w:styles>"""
#: Paragraph style, run properties, and the style's name, outline, font, size, bold, italic, caps and strike of the run.
_STYLED = [
    ("", "", "", None, "Default", 11.0, False, False, False, False), ("A", "", "alpha", 1, "Beta", 10.0, False, False, True, False), ("B", '<w:caps w:val="false"/>', "beta", 1, "Beta", 10.0, True, False, False, False),
    ("A", '<w:rStyle w:val="C"/>', "alpha", 1, "Beta", 10.0, True, False, True, True), ("X", "<w:i/>", "X", None, "Default", 10.0, False, True, False, False),
]


@derived("fn_69_style_sheet", NATIONS, "SELECT k, idx::INT AS idx, style_name, outline::INT AS outline, font_name, font_size::DOUBLE AS font_size, bold, italic, caps, strike FROM i, (VALUES " + ", ".join(f"({p}, {', '.join(map(_SQL, x[2:]))})" for p, x in enumerate(_STYLED)) + ") AS t(idx, style_name, outline, font_name, font_size, bold, italic, caps, strike)")
def style_sheet(i):
    """Styles that are based on each other, a character style, the document's defaults and an unknown style."""
    def build(k, name):
        return [(T(name, x[1]), {"ppr": f'<w:pStyle w:val="{x[0]}"/>'} if x[0] else {}) for x in _STYLED], {"word/styles.xml": SHEET}

    b = blocks(made(i, build)).withColumn("r", F.col("runs")[0])
    return b.select("k", "idx", "style_name", "outline", *[F.col(f"r.{n}").alias(n) for n in ("font_name", "font_size", "bold", "italic", "caps", "strike")])


_TOGGLES = [("<w:b/>", True), ('<w:b w:val="1"/>', True), ('<w:b w:val="true"/>', True), ('<w:b w:val="0"/>', False), ('<w:b w:val="False"/>', False), ('<w:b w:val="none"/>', False), ("", False)]


@derived("fn_21_toggles", NATIONS, "SELECT k, idx::INT AS idx, bold FROM i, (VALUES " + ", ".join(f"({p}, {b})" for p, (_, b) in enumerate(_TOGGLES)) + ") AS t(idx, bold)")
def toggles(i):
    return blocks(made(i, lambda k, name: ([(T(name, x), {}) for x, _ in _TOGGLES], {}))).select("k", "idx", F.col("runs")[0]["bold"].alias("bold"))


@derived("fn_22_names_in_namespaces", NATIONS, "SELECT k, 0::INT AS idx, name || 'other' AS text FROM i")
def namespaced(i):
    """Elements are known by their local names: runs of another namespace are runs, too."""
    return blocks(made(i, lambda k, name: ([(T(name) + '<x:r xmlns:x="urn:other"><x:t>other</x:t></x:r>', {})], {}))).select("k", "idx", "text")


@derived("win_21_removed_marks", NATIONS, """SELECT k, idx::INT AS idx, text, merged_from::INT AS merged_from FROM (SELECT k, 0 AS idx, name || ' and more of it' AS text, 3 AS merged_from FROM i UNION ALL SELECT k, 1, 'alone', 1 FROM i UNION ALL SELECT k, 2, 'before a table', 1 FROM i
  UNION ALL SELECT k, 3, 'cell', 1 FROM i UNION ALL SELECT k, 4, 'after it', 1 FROM i)""")
def removed_marks(i):
    """Paragraphs whose mark is deleted join the next; a table parts them."""
    gone = {"ppr": "<w:rPr><w:del/></w:rPr>"}

    def build(k, name):
        return [(T(name), gone), (T(" and more"), gone), (T(" of it"), {}), (T("alone"), {}), (T("before a table"), gone), (f"<w:tbl><w:tr><w:tc><w:p>{T('cell')}</w:p></w:tc></w:tr></w:tbl>", {}), (T("after it"), gone)], {}

    return blocks(made(i, build)).select("k", "idx", "text", "merged_from")


_PARTS = [("word/header2.xml", "headers", "h2"), ("word/header10.xml", "headers", "h10"), ("word/footer1.xml", "footers", "f1"), ("word/footnotes.xml", "footnotes", "fn"), ("word/endnotes.xml", "endnotes", "en"), ("word/comments.xml", "comments", "c")]


@derived("rx_26_part_names", NATIONS, "SELECT k, pos::INT AS pos, stream, part, text || k AS text FROM i, (VALUES (0, 'footers', 'word/footer1.xml', 'f1'), (1, 'headers', 'word/header10.xml', 'h10'), (2, 'headers', 'word/header2.xml', 'h2'), (3, 'footnotes', 'word/footnotes.xml', 'fn'), (4, 'endnotes', 'word/endnotes.xml', 'en'), (5, 'comments', 'word/comments.xml', 'c')) AS t(pos, stream, part, text)")
def part_names(i):
    """Headers and footers by number, in order of their names; notes and comments; other parts and empty ones are left out."""
    def build(k, name):
        part = lambda text: f"<w:x XMLNS><w:p>{T(text)}</w:p></w:x>"
        return [(T(name), {})], {**{p: part(f"{t}{k}") for p, _, t in _PARTS}, "word/headerX.xml": part("no"), "word/header3.xml": "<w:x XMLNS/>", "word/settings.xml": part("no")}

    return made(i, build).select(F.col("doc_id").alias("k"), F.posexplode("excluded").alias("pos", "e")).select("k", "pos", "e.*")


@derived("sort_06_order_of_parts", NATIONS, "SELECT k, 'footer1|header10|header2' AS parts, 'unhandled elements: alpha, beta, gamma' AS warnings FROM i")
def order_of_parts(i):
    def build(k, name):
        return [(T(name) + "<w:gamma/><w:alpha/><w:beta/><w:alpha/>", {})], {p: f"<w:x XMLNS><w:p>{T(t)}</w:p></w:x>" for p, _, t in _PARTS[:3]}

    parts = F.transform("excluded", lambda e: F.regexp_extract(e["part"], r"word/(.*)\.xml", 1))
    return made(i, build).select(F.col("doc_id").alias("k"), F.array_join(parts, "|").alias("parts"), F.array_join("warnings", "|").alias("warnings"))


@derived("src_04_damaged_files", "SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN 'no zip' WHEN 1 THEN '' END AS content FROM {nation}", "SELECT k, CASE WHEN k % 3 = 0 THEN 'BadZipFile' ELSE 'BadZipFile' END AS error, 0::INT AS n FROM i")
def damaged_files(i):
    d = docx.read_docx(i.select("k", F.col("content").cast("binary").alias("content")), "k")
    return d.select(F.col("doc_id").alias("k"), F.substring_index("error", ":", 1).alias("error"), F.size("blocks").alias("n"))


# Workbooks

BOOKS = "SELECT r_regionkey AS book, r_name AS sheet, CAST(n_nationkey AS INT) AS n, n_name AS name, CASE WHEN n_nationkey % 3 > 0 THEN n_name || ' & <co>' END AS note FROM {nation} JOIN {region} ON r_regionkey = n_regionkey"


@derived("snk_06_workbook", BOOKS, """, o AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n) + 1 AS r FROM i), h AS (SELECT DISTINCT book, sheet FROM i)
  SELECT book, sheet, r::INT AS row, c::INT AS "column", text, color FROM (SELECT book, sheet, 1 AS r, 0 AS c, 'name' AS text, NULL AS color FROM h UNION ALL SELECT book, sheet, 1, 1, 'note', NULL FROM h UNION ALL SELECT book, sheet, r, 1, note, NULL FROM o WHERE note IS NOT NULL
  UNION ALL SELECT book, sheet, r, 0, left(name, 2), NULL FROM o UNION ALL SELECT book, sheet, r, 0, substring(name, 3, 3), 'FFFF0000' FROM o UNION ALL SELECT book, sheet, r, 0, substring(name, 6), NULL FROM o WHERE length(name) > 5)""")
def workbook_cells(i):
    """A workbook for each region: a header, names with three red letters, and notes that may be empty. Read back from the files."""
    spans = ec.rich_spans(F.col("name"), F.array(F.struct(F.lit(2).alias("start"), F.lit(5).alias("end"))))
    books = workbook.workbooks(i.withColumn("name", spans), "book", "sheet", ["n"], ["name", "note"])
    return workbook.workbook_cells(books).select("book", "sheet", "row", "column", "text", "color")


# Prompts and their answers

RULES = {"form": "No question.", "case": "Headline case."}


@derived("fn_56_prompts", "SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE ' The title of ' || c_name || ' ' END AS text FROM {customer}", """SELECT k, check_, 'system|assistant|user' AS roles, trim(text) AS asked, 2::INT AS n_rules, 0.0::DOUBLE AS temperature, fields FROM i,
  (VALUES ('title', 6), ('abbreviations', 4), ('authors', 6), ('authors_review', 6), ('correspondence', 6), ('credit', 6), ('acknowledgments', 6), ('acknowledgment_parts', 2), ('acknowledgment_order', 6)) AS t(check_, fields) WHERE k % 4 > 0""".replace(", fields FROM", ", fields::INT AS fields FROM"))
def prompt_requests(i):
    """A request of each check for every text that is not blank."""
    out = None
    for check in prompts.TASKS:
        asked = prompts.requests(i, check, RULES, "m", examples={"a": "b"})
        p = F.from_json("payload", "model string, temperature double, messages array<struct<role:string,content:string>>")
        one = asked.withColumn("p", p).select("k", F.col("check").alias("check_"), F.array_join("p.messages.role", "|").alias("roles"), F.element_at("p.messages.content", -1).alias("asked"),
                                              F.regexp_count(F.col("p.messages")[0]["content"], F.lit("(?m)^- (form|case): ")).alias("n_rules"), "p.temperature", F.regexp_count(F.regexp_extract(F.col("p.messages")[0]["content"], r"objects (\{.*\})", 1), F.lit('"[a-z_]+":')).alias("fields"))
        out = one if out is None else out.unionByName(one)
    return out


ANSWERED = """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '' ELSE 'The title of ' || c_name END AS text, CASE c_custkey % 4 WHEN 1 THEN '[{"guideline_followed": False, "guideline_id": "form", "reason": "r", "affected_text": "title", "suggested_replacement": "NA", "edit_score": 0.' || (c_custkey % 10) || '}, {"guideline_followed": true, "guideline_id": "case"}]'
  WHEN 2 THEN 'no objects' WHEN 0 THEN '[{"guideline_id": "never asked"}]' END AS response FROM {customer}"""


@derived("fn_57_check_drivers", ANSWERED, "SELECT k, 0::INT AS pos, false AS guideline_followed, 'form' AS guideline_id, (k % 10)::DOUBLE / 10 AS edit_score FROM i WHERE k % 4 = 1 UNION ALL SELECT k, 1, true, 'case', NULL FROM i WHERE k % 4 = 1")
def check_drivers(i):
    """Blank texts are not asked about, so that answers to them count for nothing; requests without an answer give nothing."""
    asked = prompts.requests(i.select("k", "text"), "title", RULES, "m")
    found = prompts.findings(asked, i.filter("k % 4 <> 3").select("k", F.lit("title").alias("check"), "response"), "title", ["k"])
    return found.select("k", "pos", "guideline_followed", "guideline_id", "edit_score")


# Providers

DOIS = "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 8 = 7 THEN '' ELSE CAST(s_suppkey % 8 AS VARCHAR(9)) || '/x' END AS doi FROM {supplier}"


def _openalex(key: str) -> providers.Answer:
    kind = int(key[0])
    if kind == 5:
        raise TimeoutError
    return (200, {}, json.dumps({"title": key})) if kind == 0 else (200, {}, "[1]") if kind == 1 else (404, {}, "") if kind in (2, 3) else (503, {"Retry-After": "9"}, "")


def _crossref(key: str) -> providers.Answer:
    kind = int(key[0])
    return (200, {}, json.dumps({"message": {"title": [key]}})) if kind in (1, 2) else (200, {}, json.dumps({"status": "ok"})) if kind == 3 else (418, {}, "") if kind == 4 else (404, {}, "")


@derived("src_09_metadata_provider", DOIS, """SELECT k, CASE k % 8 WHEN 0 THEN 'openalex' WHEN 1 THEN 'crossref' WHEN 2 THEN 'crossref' END AS source, CASE k % 8 WHEN 0 THEN doi WHEN 1 THEN doi WHEN 2 THEN doi END AS title,
  CASE k % 8 WHEN 3 THEN 'crossref_invalid_response' WHEN 4 THEN 'crossref_http_418' WHEN 5 THEN 'crossref_not_found' WHEN 6 THEN 'crossref_not_found' END AS error, k % 8 < 3 AS success FROM i""")
def metadata_provider(i):
    """Two sources in order, with every kind of answer."""
    found = providers.metadata_provider([("openalex", _openalex), ("crossref", _crossref)], sleep=lambda _: None)(i.select("k", "doi"))
    title = F.coalesce(F.get_json_object("metadata", "$.title[0]"), F.get_json_object("metadata", "$.title"))
    return found.select("k", "source", title.alias("title"), "error", "success")


@derived("src_10_job_states", "SELECT s_suppkey AS k, CASE s_suppkey % 6 WHEN 0 THEN 'completed' WHEN 1 THEN 'true' WHEN 2 THEN 'Error' WHEN 3 THEN 'RUNNING' WHEN 4 THEN 'FAILED' END AS status FROM {supplier}",
         "SELECT k, CASE WHEN k % 6 < 2 THEN 'done' WHEN k % 6 IN (2, 4) THEN 'failed' ELSE 'pending' END AS state, CASE WHEN k % 6 < 2 THEN 'done' WHEN k % 6 IN (2, 4) THEN 'failed' WHEN k % 6 = 3 THEN 'timeout' END AS outcome, CASE WHEN k % 6 < 2 THEN upper(status) END AS response FROM i", heavy=True)
def job_states(i):
    """States by column, and jobs that are submitted and asked for until they end; without a payload nothing is sent."""
    run = providers.job_provider(lambda payload: payload, lambda job: (job, job.upper()), "status", timeout=0.02, interval=0.01, at_once=16)
    outcome = run(i.select("k", "status"))
    return outcome.select("k", providers.job_state(F.col("status")).alias("state"), "outcome", F.when(F.col("outcome") == "done", F.col("response")).alias("response"))


@derived("src_11_structured_references", "SELECT s_suppkey AS k, s_name AS ref FROM {supplier}", "SELECT k, ref, CASE WHEN k % 2 = 0 THEN 'Author of ' || ref END AS author FROM i")
def structured_references(i):
    answers = i.filter("k % 2 = 0").select("ref", F.concat(F.lit("Author of "), "ref").alias("author"))
    return providers.from_table(answers, ["ref"])(i).select("k", "ref", "author")


SIMILAR = "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_name || ' one' WHEN 1 THEN repeat('ab', 150) || 'x' || repeat('ab', 150) WHEN 2 THEN '' ELSE 'abcd' END AS x, CASE p_partkey % 4 WHEN 0 THEN p_name || ' two' WHEN 1 THEN repeat('ab', 150) || 'y' || repeat('ab', 150) WHEN 2 THEN '' ELSE 'bcde' END AS y, p_name FROM {part}"


@derived("fn_61_similarity", SIMILAR, "SELECT k, CASE k % 4 WHEN 0 THEN (length(p_name) + 2) / (length(p_name) + 4) WHEN 1 THEN 300 / 601 WHEN 2 THEN 1.0 ELSE 0.75 END::DOUBLE AS ratio FROM i", heavy=True)
def similarity(i):
    """Long texts of few characters are compared as far as they agree from the start: frequent characters count as junk there."""
    pair = F.array(F.struct(F.col("x"), F.col("y"), F.lit(0.0).alias("least")))
    return i.select("k", F.get(duplicates.ratios(pair), F.lit(0)).alias("ratio"))


#: Neighbouring parts' names, and by brute force their longest common subsequence: a row of the table for each character.
NAME_PAIRS = "SELECT a.p_partkey AS k, lower(a.p_name) AS x, lower(b.p_name) AS y FROM {part} AS a JOIN {part} AS b ON b.p_partkey = a.p_partkey + 1"


@query("fn_61_name_similarity", f"""WITH RECURSIVE i AS ({NAME_PAIRS}), r AS (
    SELECT k, x, y, 0 AS n, list_transform(range(length(y) + 1), lambda j: 0) AS line FROM i
    UNION ALL SELECT k, x, y, n + 1, list_transform(range(length(y) + 1), lambda j: list_max(list_transform(range(j + 1), lambda q: greatest(line[q + 1], CASE WHEN q > 0 AND substring(y, q::INT, 1) = substring(x, n + 1, 1) THEN line[q] + 1 ELSE 0 END)))) FROM r WHERE n < length(x))
  SELECT k, round(200.0::DOUBLE * line[length(y) + 1] / (length(x) + length(y)), 6) AS similarity, round(200.0::DOUBLE * line[length(y) + 1] / (length(x) + length(y)), 6) >= 60 AS alike FROM r WHERE n = length(x)""")
def name_similarity_of_parts(spark, sf_dir):
    i = source(spark, sf_dir, NAME_PAIRS)
    x, y = F.col("x"), F.col("y")
    return i.select("k", F.round(similarity_of_names.name_similarity(x, y), 6).alias("similarity"), (similarity_of_names.name_similarity(x, y, 60.0) > 0).alias("alike"))
