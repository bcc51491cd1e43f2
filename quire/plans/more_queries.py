"""Queries over order-dependent operators, element checks, records and small functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import citations as ct
from quire.functions import text as tx
from quire.operators import element_checks as ec
from quire.operators import duplicates, headings, sections
from quire.operators import sequences as sq
from quire.operators import style_rules as sr
from quire.plans.registry import derived, query, source
from quire.plans.text_queries import MANUSCRIPT, PAGED, RAW
from quire.sources import text_reader as reader

_SEQ = "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS idx, min(l_partkey) AS p, min(l_suppkey) AS s FROM {lineitem} GROUP BY l_orderkey, l_linenumber"


@derived("agg_12_mark_upsert", "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS idx, 1 AS level, l_partkey AS seq, l_returnflag AS section_type, CAST(l_suppkey % 3 AS DOUBLE) AS conf FROM {lineitem}",
         "SELECT doc_id, idx, level, min(seq) AS seq, max(conf) AS conf FROM i GROUP BY doc_id, idx, level")
def mark_upsert(i):
    return sq.upsert_marks(i).select("doc_id", "idx", "level", "seq", "conf")


@derived("win_10_longest_run", _SEQ, """, f AS (SELECT *, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS g FROM i WHERE p % 3 > 0), r AS (SELECT doc_id, min(idx) AS start, count(*) AS n FROM f GROUP BY doc_id, g)
  SELECT doc_id, start::INT AS start, n AS length FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, start) AS k FROM r) WHERE k = 1""")
def longest_run(i):
    return sq.longest_run(i.withColumn("on", F.col("p") % 3 > 0), "on")


@derived("win_12_leading_run", _SEQ, """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM i) SELECT doc_id, least(coalesce(min(CASE WHEN p % 4 = 0 THEN k END) - 1, max(k)), 3)::INT AS length FROM r GROUP BY doc_id""")
def leading_run(i):
    return sq.leading_run(i.withColumn("on", F.col("p") % 4 > 0), "on", 3)


@derived("win_14_type_groups", _SEQ, """, n AS (SELECT *, CASE WHEN lag(p % 2) OVER w = p % 2 AND lag(idx) OVER w = idx - 1 THEN 0 ELSE 1 END AS new FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY idx) AS grp FROM n) SELECT doc_id, grp::BIGINT AS grp, min(idx) AS first, max(idx) AS last, any_value(p % 2) AS kind FROM g GROUP BY doc_id, grp""")
def type_groups(i):
    return sq.type_groups(i.withColumn("kind", F.col("p") % 2), "kind")


@derived("win_15_without_overlaps", "SELECT n_nationkey AS k, CAST(n_nationkey % 7 AS INT) AS a FROM {nation}", "SELECT k, 'x' || a || '-' || (a + 5) || '|x' || (a + 5) || '-' || (a + 6) AS kept FROM i")
def without_overlaps(i):
    span = lambda s, e: F.struct((F.col("a") + s).alias("start"), (F.col("a") + e).alias("end"))
    kept = sq.without_overlaps(F.array(span(1, 4), span(0, 2), span(5, 6), span(0, 5), span(3, 9)))
    return i.select("k", F.array_join(F.transform(kept, lambda s: F.concat(F.lit("x"), s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), "|").alias("kept"))


@derived("join_15_stronger_later", _SEQ, "SELECT a.doc_id, a.idx, exists(SELECT 1 FROM i b WHERE b.doc_id = a.doc_id AND b.p % 2 = a.p % 2 AND b.idx > a.idx AND b.s % 3 > a.s % 3) AS later FROM i a")
def stronger_later(i):
    return sq.stronger_later(i.select("doc_id", "idx", (F.col("p") % 2).alias("type"), (F.col("s") % 3).alias("strength"))).select("doc_id", "idx", "later")


@derived("join_09_duplicate_chains", "SELECT 1 AS doc_id, c_custkey AS id, CASE WHEN c_custkey >= 100 THEN c_custkey - 100 END AS duplicate_of FROM {customer}", "SELECT doc_id, id, id % 100 AS duplicate_of FROM i WHERE id >= 100")
def duplicate_chains(i):
    return sq.chain_ends(i)


@derived("win_22_soft_lines", "SELECT n_nationkey AS doc_id, n_name AS name FROM {nation}", "SELECT doc_id, CAST(l AS BIGINT) AS line, CASE l WHEN 0 THEN 'A' || name ELSE 'b end' END AS text FROM i, range(2) AS t(l)")
def soft_lines(i):
    rows = i.select("doc_id", F.posexplode(F.array(F.lit("A"), F.concat("name", F.lit("\nb")), F.lit(" end"))).alias("run", "text"))
    return sq.soft_lines(rows)


@derived("win_20_bold_prefix", "SELECT p_partkey AS k, p_name AS name, p_partkey % 3 AS m FROM {part}", "SELECT k, CASE m WHEN 0 THEN length(name) + 1 WHEN 1 THEN 0 ELSE length(name) + 2 END::INT AS n FROM i")
def bold_prefix(i):
    run = lambda t, b: F.struct(t.alias("text"), b.alias("bold"))
    runs = F.array(run(F.col("name"), F.col("m") != 1), run(F.lit(" "), F.lit(False)), run(F.lit("x"), F.col("m") == 2), run(F.lit("y"), F.lit(False)))
    return i.select("k", headings.bold_prefix(runs).cast("int").alias("n"))


@derived("prj_02_structural_signals", "SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'METHODS' WHEN 1 THEN 'Some words of a part' ELSE 'A rather long line of text that holds many words and no signals at all' END AS raw FROM {part}",
         "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'allcaps(1.00)|short-standalone' WHEN 1 THEN 'short-standalone' ELSE '' END AS signals FROM i")
def structural_signals(i):
    return reader.read_blocks(i).select("doc_id", F.array_join(headings.signals(), "|").alias("signals"))


@derived("agg_17_checkboxes", "SELECT c_custkey AS k, repeat('☐ a ☑', CAST(c_custkey % 4 AS INT)) || '☒' AS s FROM {customer}", "SELECT k, 2 * (k % 4) + 1 AS n FROM i")
def checkboxes(i):
    return i.select("k", tx.count_of(F.col("s"), f"[{duplicates.CHECKBOXES}]").cast("bigint").alias("n"))


_ORDERED = "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS id, CAST(NULL AS INT) AS parent_id, CASE l_linenumber % 4 WHEN 0 THEN 'Methods' WHEN 1 THEN 'introduction' WHEN 2 THEN 'Odd One' ELSE 'RESULTS' END AS name, CAST(l_linenumber * 10 AS INT) AS start_position FROM {lineitem} GROUP BY l_orderkey, l_linenumber"


@derived("rule_03_trailing_parenthetical", "SELECT p_partkey AS doc_id, 'Abstract (' || p_size || '/300 words)' AS raw FROM {part}", "SELECT doc_id, 'abstract' AS section_type, true AS noted FROM i")
def trailing_parenthetical(i):
    s = headings.screened(reader.read_blocks(i))
    return s.select("doc_id", "cand.section_type", F.array_contains("cand.signals", "trailing-parenthetical-stripped").alias("noted"))


_M = f"WITH m AS ({MANUSCRIPT})"


@query("flt_05_top_level_sections", f"{_M} SELECT doc_id, 10::BIGINT AS n FROM m")
def top_level_sections(spark, sf_dir):
    s = sections.extract_sections(source(spark, sf_dir, RAW, dealt=True))
    return s.filter("level = 1 and duplicate_of is null").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("snk_03_document_json", f"{_M} SELECT doc_id, title, 'REFERENCES' || chr(10) || ref1 || chr(10) || ref2 AS refs, 14::INT AS n FROM m")
def document_json(spark, sf_dir):
    d = sections.extract_documents(source(spark, sf_dir, RAW, dealt=True))
    j = d.select("doc_id", F.to_json(F.struct(*[F.col(f"`{e}`") for e in sections.ELEMENTS])).alias("j"))
    m = F.from_json("j", "map<string,string>")
    return j.select("doc_id", m.alias("m")).select("doc_id", F.col("m")["Title"].alias("title"), F.col("m")["References"].alias("refs"), F.size("m").alias("n"))


@query("snk_01_section_json", f"{_M} SELECT doc_id, 'title' AS section_type, 'Title' AS element, 0.6::DOUBLE AS confidence FROM m")
def section_json(spark, sf_dir):
    s = sections.section_records(sections.extract_sections(source(spark, sf_dir, RAW, dealt=True)).filter("section_type = 'title'"))
    j = s.select("doc_id", F.to_json(F.struct("id", "section_type", "standard_element", "confidence")).alias("j"))
    return j.select("doc_id", F.get_json_object("j", "$.section_type").alias("section_type"), F.get_json_object("j", "$.standard_element").alias("element"), F.get_json_object("j", "$.confidence").cast("double").alias("confidence"))


# Element checks

ELEMENTS = """SELECT c_custkey AS k, 'correspondence' AS element, CASE c_custkey % 3 WHEN 0 THEN 'Address correspondence to: Jane Doe, MD, 1 Main Street, Town CO. E-mail: j@x.edu.' WHEN 1 THEN 'Write to Dr. Jane Doe, 1 Main St., phone 123, fax 9' ELSE '' END AS text FROM {customer}
  UNION ALL SELECT c_custkey, 'credit', CASE c_custkey % 2 WHEN 0 THEN 'CRediT Author Statement' || chr(10) || 'Jane Doe: Software, Validation; John Roe: Supervision.' ELSE 'J D: Coffee' END FROM {customer}"""


@derived("fn_58_element_checks", ELEMENTS, """SELECT k, element, g AS guideline_id, k % 3 = 0 AS followed FROM i, (VALUES ('start_constraint'), ('degrees_constraint'), ('email_constraint'), ('abbreviation_constraint'), ('phone_constraint'), ('fax_constraint'), ('title_constraint'), ('end_constraint')) AS r(g)
  WHERE element = 'correspondence' AND k % 3 < 2 UNION ALL SELECT k, element, g, k % 2 = 0 OR g = 'format_constraint' FROM i, (VALUES ('start_constraint'), ('fullname_constraint'), ('role_constraint'), ('format_constraint')) AS r(g) WHERE element = 'credit'""")
def element_checks(i):
    return ec.check_elements(i).select("k", "element", "guideline_id", "followed")


@derived("snk_11_rich_spans", "SELECT p_partkey AS k, p_name AS s FROM {part}", "SELECT k, concat_ws('|', 'P' || nullif(left(s, 1), ''), 'H' || nullif(substring(s, 2, 2), ''), 'P' || nullif(substring(s, 4), '')) AS shown FROM i")
def rich_spans(i):
    spans = F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end")))
    parts = ec.rich_spans(F.col("s"), spans)
    return i.select("k", F.array_join(F.transform(parts, lambda p: F.concat(F.when(p["highlighted"], "H").otherwise("P"), p["text"])), "|").alias("shown"))


# Small functions

@derived("fn_52_clean", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '  ' || c_name || ' ' || chr(9) END AS s, c_acctbal AS b FROM {customer}", "SELECT k, CASE WHEN k % 3 = 0 THEN '' ELSE c_name END AS s FROM i JOIN customer ON k = c_custkey")
def clean(i):
    return i.select("k", ct.clean(F.col("s")).alias("s"))


@derived("fn_50_starts_lowercase", "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '-da' WHEN 1 THEN 'Rui' WHEN 2 THEN '12' ELSE 'été' END AS s FROM {customer}", "SELECT k, k % 4 IN (0, 3) AS low FROM i")
def starts_lowercase(i):
    return i.select("k", F.coalesce(ct._starts_lower(F.col("s")), F.lit(False)).alias("low"))


@derived("fn_64_year_in_text", "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '20 Mar ' || year(o_orderdate) WHEN 1 THEN year(o_orderdate) || '' WHEN 2 THEN '3020 May' ELSE 'May' END AS y, o_orderdate AS d FROM {orders}",
         "SELECT k, CASE WHEN k % 4 < 2 THEN year(d) || ';7' ELSE CASE k % 4 WHEN 2 THEN 'None;7' ELSE 'May;7' END END AS shown FROM i")
def year_in_text(i):
    """A year of more than four characters is cut to its four digits, or becomes None."""
    none = F.lit("").cast("string")
    return i.select("k", ct.format_numbers(F.struct(F.col("y").alias("year"), F.lit("7").alias("volume"), none.alias("issue"), none.alias("pages"), none.alias("article_number"))).alias("shown"))


@derived("set_05_present_sections", _ORDERED, """, n AS (SELECT DISTINCT doc_id, upper(name) AS n FROM i) SELECT doc_id, concat_ws('|', CASE WHEN bool_or(n = 'INTRODUCTION') THEN 'contains_introduction' END, CASE WHEN bool_or(n = 'METHODS') THEN 'contains_methods' END,
  CASE WHEN bool_or(n = 'RESULTS') THEN 'contains_results' END) AS present, concat_ws('|', CASE WHEN NOT bool_or(n = 'INTRODUCTION') THEN 'INTRODUCTION' END, CASE WHEN NOT bool_or(n = 'METHODS') THEN 'METHODS' END, CASE WHEN NOT bool_or(n = 'RESULTS') THEN 'RESULTS' END, 'DISCUSSION', 'CONCLUSIONS') AS missing,
  bool_or(n = 'ODD ONE') AS odd FROM n GROUP BY doc_id""")
def present_sections(i):
    o = sr.check_order(i)
    has = F.filter("followed", lambda x: x.startswith("contains_"))
    missing = F.transform(F.filter("issues", lambda x: x.startswith("Missing")), lambda x: F.regexp_extract(x, "'([^']*)'", 1))
    return o.select("doc_id", F.array_join(has, "|").alias("present"), F.array_join(missing, "|").alias("missing"), F.exists("issues", lambda x: x.startswith("Unexpected")).alias("odd"))


# Documents of three pages: their records hold the sections and the excluded lines by stream.
@derived("snk_02_document_record", PAGED, """SELECT doc_id, 2::INT AS n_sections, CASE WHEN doc_id % 2 = 0 THEN 'headers_footers|page_numbers' ELSE 'page_numbers' END AS streams, CASE WHEN doc_id % 2 = 0 THEN 3 END::INT AS n_heads, '2|page 1 of 3' AS numbers,
  concat_ws('|', CASE WHEN doc_id % 2 = 0 THEN 'repeated-headers:3' END, 'no-references:1', 'unlabeled-spans:1') AS warnings FROM i""")
def document_record(i):
    docs = sections.read_sections(i)
    r = sections.document_records(docs, reader.split_streams(reader.text_lines(i))[1].unionByName(i.select("doc_id", F.lit("footnotes").alias("stream"), F.lit(0).alias("page"), F.lit(0).alias("line"), F.lit("").alias("text"))))
    m = F.col("excluded_streams")
    heads = F.try_element_at(m, F.lit("headers_footers"))
    return r.select("doc_id", F.size("sections").alias("n_sections"), F.array_join(F.array_sort(F.map_keys(m)), "|").alias("streams"), F.when(heads.isNotNull(), F.size(heads)).alias("n_heads"), F.array_join(F.try_element_at(m, F.lit("page_numbers")), "|").alias("numbers"),
                    F.array_join(F.transform("warnings", lambda w: F.concat_ws(":", w["code"], w["block"], w["count"])), "|").alias("warnings"))
