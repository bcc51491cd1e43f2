"""Queries over DOCX files that are made from the tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import sections
from quire.plans.registry import derived
from quire.sources import docx

STYLES = """<w:styles XMLNS><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Times"/><w:sz w:val="24"/></w:rPr></w:rPrDefault></w:docDefaults>
<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>
<w:style w:type="paragraph" w:styleId="Base"><w:name w:val="base"/><w:rPr><w:b/><w:rFonts w:ascii="Franklin Gothic Medium"/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/><w:basedOn w:val="Base"/><w:rPr><w:sz w:val="28"/></w:rPr><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style></w:styles>"""
NATIONS = "SELECT n_nationkey AS k, n_name AS name FROM {nation}"


def _files(i: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name in b.column(1).to_pylist():
                t = lambda x: f"<w:r><w:t>{x}</w:t></w:r>"
                paragraphs = [
                    (t("METHODS"), {"ppr": '<w:pStyle w:val="Heading1"/>'}), ("", {}),
                    (f"<w:r><w:rPr><w:i/></w:rPr><w:t>People of </w:t></w:r>{t(name)}<w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins>{t(' new')}</w:ins>", {}),
                    ("<w:r><w:t>left</w:t><w:br/><w:t>right</w:t></w:r>", {}), (t("joined "), {"ppr": "<w:rPr><w:del/></w:rPr>"}), (t("up"), {}),
                    (f"<w:tbl><w:tr><w:tc><w:p>{t('a')}</w:p></w:tc><w:tc><w:p>{t('b')}</w:p></w:tc></w:tr></w:tbl>", {}),
                ]
                out.append(docx.make_docx(paragraphs, {"word/styles.xml": STYLES, "word/header1.xml": f"<w:hdr XMLNS><w:p>{t('Head of ' + name)}</w:p></w:hdr>"}))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["k", "content"])

    return i.select("k", "name").mapInArrow(run, "k int, content binary")


@derived("src_04_docx_blocks", NATIONS, """, t AS (SELECT k, idx, CASE idx WHEN 0 THEN 'METHODS' WHEN 1 THEN 'People of ' || name || ' new' WHEN 2 THEN 'left' WHEN 3 THEN 'right' WHEN 4 THEN 'joined up' ELSE 'a' || chr(9) || 'b' END AS text FROM i, range(6) AS r(idx))
  SELECT k, idx::INT AS idx, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY k ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start, CASE idx WHEN 5 THEN NULL WHEN 0 THEN 'Heading1' ELSE '' END AS style,
  CASE WHEN idx = 1 THEN 1 ELSE 0 END::INT AS blank_before, idx = 5 AS is_table, CASE WHEN idx = 4 THEN 2 ELSE 1 END::INT AS merged_from, CASE WHEN idx = 0 THEN 1 END::INT AS style_heading_level FROM t""")
def docx_blocks(i):
    b = docx.docx_blocks(docx.read_docx(_files(i), "k"))
    return b.select(F.col("doc_id").alias("k"), "idx", "text", "start", "style", "blank_before", "is_table", "merged_from", "style_heading_level")


@derived("src_12_excluded_streams", NATIONS, "SELECT k, 'headers' AS stream, 'word/header1.xml' AS part, 'Head of ' || name AS text FROM i")
def excluded_streams(i):
    return docx.read_docx(_files(i), "k").select(F.col("doc_id").alias("k"), F.explode("excluded").alias("e")).select("k", "e.*")


@derived("join_11_run_formatting", NATIONS, """SELECT k, idx::INT AS idx, pos::INT AS pos, CASE WHEN idx = 0 THEN 'Franklin Gothic Medium' ELSE 'Times' END AS font_name, CASE WHEN idx = 0 THEN 14.0 ELSE 12.0 END::DOUBLE AS font_size, idx = 0 AS bold, idx = 1 AND pos = 0 AS italic
  FROM i, (VALUES (0, 0), (1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (4, 0), (4, 1)) AS r(idx, pos)""")
def run_formatting(i):
    b = docx.docx_blocks(docx.read_docx(_files(i), "k"))
    return b.select(F.col("doc_id").alias("k"), "idx", F.posexplode("runs").alias("pos", "r")).select("k", "idx", "pos", "r.font_name", "r.font_size", "r.bold", "r.italic")


@derived("flt_06_span_styles", NATIONS, """SELECT k, idx::INT AS idx, run::INT AS run, greatest(a, 4)::INT AS start_char, least(z, 14)::INT AS end_char FROM (SELECT k, 0 AS idx, 0 AS run, 0 AS a, 7 AS z FROM i UNION ALL SELECT k, 1, 0, 8, 18 FROM i)""")
def span_styles(i):
    b = docx.docx_blocks(docx.read_docx(_files(i), "k"))
    spans = i.select(F.col("k").alias("doc_id"), F.lit(4).alias("span_start"), F.lit(14).alias("span_end"))
    return sections.span_styles(b, spans).select(F.col("doc_id").alias("k"), "idx", "run", "start_char", "end_char")


@derived("rule_13_docx_section_tree", NATIONS, "SELECT k AS doc_id, 1::INT AS id, 'methods' AS section_type, 'METHODS' AS name, 0::INT AS start_position, (length('METHODS' || 'People of ' || name || ' new' || 'left' || 'right' || 'joined up' || 'a b') + 5)::INT AS end_position FROM i")
def docx_section_tree(i):
    """Sections of the made files, from formatting: a heading style opens the methods."""
    b = docx.docx_blocks(docx.read_docx(_files(i), "k"))
    return sections.section_records(sections.sections_of_blocks(b, text_mode=False)).select("doc_id", "id", "section_type", "name", "start_position", "end_position")


CHAINS = "SELECT c_nationkey AS doc_id, c_custkey AS style_id, CASE WHEN c_custkey >= 100 THEN c_custkey - 100 END AS based_on, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS font FROM (SELECT 1 AS c_nationkey, c_custkey, c_mktsegment FROM {customer}) AS c"


@derived("join_10_style_inheritance", CHAINS, """, r AS (SELECT a.style_id, b.style_id AS anc, b.font FROM i a JOIN i b ON b.style_id <= a.style_id AND (a.style_id - b.style_id) % 100 = 0 WHERE b.font IS NOT NULL)
  SELECT i.doc_id, i.style_id, arg_max(r.font, anc) AS font FROM i LEFT JOIN r USING (style_id) GROUP BY ALL""")
def style_inheritance(i):
    return docx.resolve_inheritance(i, "font")
