"""Queries over heading rules, reports, titles and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions import titles as tt
from quire.operators import style_rules as sr
from quire.operators.sections import merge_ranges
from quire.plans.registry import derived, query

# A section for every part: level 1 to 5, and style attributes that pass or fail by the part's number.
STYLED = """SELECT p_partkey AS id, CAST(p_partkey % 5 + 1 AS INT) AS level, p_size AS size, CAST(p_partkey % 3 AS INT) AS f, CAST(p_partkey % 2 AS INT) AS b, CAST(p_partkey % 7 AS INT) AS z,
  CASE p_partkey % 4 WHEN 0 THEN 'METHODS' WHEN 1 THEN 'Study Sample' WHEN 2 THEN 'Data were clean.' ELSE 'odd Name' END AS name FROM {part}"""
_TYPE = "struct<font_name:string,font_size:double,bold:boolean,italic:boolean,underline:string,strike:boolean,color:string,highlight:string,vert_align:string,all_caps:boolean>"


def _style(font: str, size: str, bold: str, italic: str) -> Column:
    return F.expr(f"named_struct('font_name', {font}, 'font_size', CAST({size} AS DOUBLE), 'bold', {bold}, 'italic', {italic}, 'underline', CAST(NULL AS STRING), 'strike', false, 'color', CAST(NULL AS STRING), "
                  "'highlight', CAST(NULL AS STRING), 'vert_align', CAST(NULL AS STRING), 'all_caps', false)").cast(_TYPE)


def _styled(i: DataFrame) -> DataFrame:
    head = _style("CASE f WHEN 0 THEN ' franklin  Gothic MEDIUM' WHEN 1 THEN 'Arial' END", "CASE WHEN z = 0 THEN 14 WHEN z = 1 THEN 11 ELSE 12 END", "b = 1", "f = 2")
    body = _style("'Arial'", "12", "false", "false")
    item = lambda text, style, stop: F.struct(text.alias("text"), style.alias("style"), F.lit(stop).alias("paragraph_break"))
    ranges = F.array(item(F.col("name"), head, False), item(F.lit("\n"), F.lit(None).cast(_TYPE), True), item(F.lit("body"), body, False)).cast(f"array<{sr.RANGE}>")
    short = F.slice(ranges, 1, 1)
    none = F.array().cast(f"array<{sr.RANGE}>")
    picked = F.when(F.col("z") == 6, none).when(F.col("z") == 5, short).otherwise(ranges)
    return i.select(F.lit(1).alias("doc_id"), "id", "level", "name", F.concat("name", F.lit("\nbody")).alias("extracted_text"), picked.alias("ranges"), F.lit(None).cast("bigint").alias("parent_id"))


def _rules() -> str:
    caps, headline, sentence, period = "name = 'METHODS'", "name IN ('METHODS', 'Study Sample')", "name IN ('Data were clean.', 'METHODS')", "name = 'Data were clean.'"
    bold, plain, italic, font = "b = 1", "f <> 2", "f = 2", "f = 0"
    body, has = ("f = 1", "z BETWEEN 2 AND 4"), "z <= 4"
    rules = [(1, "h1_all_caps", caps, "t", "true"), (1, "h1_font_name", font, "s", "true"), (1, "h1_font_size", "z = 0", "s", "true"), (1, "h1_bold", bold, "s", "true"), (1, "h1_not_italic", plain, "s", "true"),
             (2, "h2_headline_case", headline, "t", "true"), (2, "h2_font_name", font, "s", "true"), (2, "h2_font_size", "z = 1", "s", "true"), (2, "h2_bold", bold, "s", "true"), (2, "h2_not_italic", plain, "s", "true")]
    for n, slant in ((3, ("h3_not_italic", plain)), (4, ("h4_italic", italic))):
        rules += [(n, f"h{n}_sentence_case", sentence, "t", "true"), (n, f"h{n}_final_period", period, "t", "true"), (n, f"h{n}_bold", bold, "s", "true"), (n, slant[0], slant[1], "s", "true"), (n, f"h{n}_font_name", body[0], "s", has), (n, f"h{n}_font_size", body[1], "s", has)]

    def pick(want: bool, kinds: str) -> str:
        return "concat_ws('|', " + ", ".join(f"CASE WHEN level = {n} AND {on} AND {'' if want else 'NOT '}({rule}) THEN '{key}' END" for n, key, rule, kind, on in rules if kind in kinds) + ")"

    return f"""SELECT id, CASE WHEN z = 6 THEN '' ELSE {pick(True, 'ts')} END AS followed, CASE WHEN z = 6 THEN 'no_styled_text' WHEN level = 5 THEN 'Unsupported heading level: 5' ELSE {pick(False, 's')} END AS style_issues,
      CASE WHEN z = 6 THEN 'no_heading_text' ELSE {pick(False, 't')} END AS text_issues FROM i"""


@derived("rule_16_heading_style", STYLED, _rules())
def heading_style(i):
    s = sr.add_style_checks(_styled(i))
    return s.select("id", F.array_join("style_followed", "|").alias("followed"), F.array_join("style_issues", "|").alias("style_issues"), F.array_join("text_issues", "|").alias("text_issues"))


@derived("flt_08_styled_runs", STYLED, "SELECT id, CASE WHEN z = 6 THEN 0 WHEN z = 5 THEN 1 ELSE 2 END::INT AS n_runs, CASE WHEN z <= 4 THEN 'Arial' END AS body_font FROM i")
def styled_runs(i):
    s = _styled(i)
    return s.select("id", F.size(sr.text_runs(F.col("ranges"))).alias("n_runs"), sr.body_style(F.col("ranges"))["font_name"].alias("body_font"))


# Section trees: a region is a document, nations its sections; names and parents follow the nation's number.
TREES = """SELECT n_regionkey AS doc_id, CAST(n_nationkey AS BIGINT) AS id, CASE n_nationkey % 6 WHEN 0 THEN 'Introduction' WHEN 1 THEN 'METHODS' WHEN 2 THEN ' Study  sample ' WHEN 3 THEN 'Limitations' WHEN 4 THEN 'Conclusions' ELSE n_name END AS name,
  CAST(CASE n_nationkey % 6 WHEN 2 THEN 2 ELSE 1 END AS INT) AS level, CAST(CASE WHEN n_nationkey % 6 = 2 THEN (SELECT max(m.n_nationkey) FROM {nation} m WHERE m.n_regionkey = n.n_regionkey AND m.n_nationkey % 6 = 1) WHEN n_nationkey % 6 = 4 THEN n_nationkey - 5 END AS BIGINT) AS parent_id,
  CAST(n_nationkey * 10 AS INT) AS start_position FROM {nation} n"""
_EXPECT = "e(norm, el, ep) AS (VALUES " + ", ".join(f"('{n}', {k}, {'NULL' if p is None else repr(p)})" for n, k, p in sr.HIERARCHY) + ")"
_HIER = f""", {_EXPECT}, s AS (SELECT *, upper(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS norm FROM i), p AS (SELECT doc_id, norm AS ep, max(id) AS want FROM s GROUP BY ALL),
  h AS (SELECT s.*, el, e.ep, want, q.name AS pname FROM s LEFT JOIN e USING (norm) LEFT JOIN p ON p.doc_id = s.doc_id AND p.ep = e.ep LEFT JOIN s q ON q.doc_id = s.doc_id AND q.id = s.parent_id),
  r AS (SELECT doc_id, id, el IS NOT NULL AND el = level AS lv, CASE WHEN el IS NULL THEN false WHEN ep IS NULL THEN parent_id IS NULL ELSE coalesce(parent_id = want, false) END AS pa, el, ep, level, want, parent_id, coalesce(pname, 'id=' || coalesce(parent_id || '', 'None')) AS pname FROM h)"""


@derived("rule_17_hierarchy", TREES, _HIER + """ SELECT doc_id, id, concat_ws('|', CASE WHEN lv THEN 'correct_level' END, CASE WHEN pa THEN 'correct_parent' END) AS followed,
  CASE WHEN el IS NULL THEN 'Section is not defined in expected hierarchy' ELSE concat_ws('|', CASE WHEN NOT lv THEN 'Expected level ' || el || ', found level ' || level END, CASE WHEN NOT pa THEN
    CASE WHEN ep IS NULL THEN 'Expected parent_id=None, found parent ''' || pname || ''' (id=' || parent_id || ')' WHEN want IS NULL THEN 'Expected parent ''' || ep || ''' does not exist'
    ELSE 'Expected parent_id=' || want || ' (''' || ep || '''), found parent_id=' || coalesce(parent_id || '', 'None') || ' (''' || pname || ''')' END END) END AS issues FROM r""")
def hierarchy(i):
    return sr.check_hierarchy(i).select("doc_id", "id", F.array_join("hierarchy_followed", "|").alias("followed"), F.array_join("hierarchy_issues", "|").alias("issues"))


_TOP = ", s AS (SELECT *, upper(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS norm FROM i WHERE parent_id IS NULL), d AS (SELECT DISTINCT doc_id FROM i), a AS (SELECT doc_id, list(norm ORDER BY start_position, id) AS names FROM s GROUP BY doc_id), t AS (SELECT doc_id, coalesce(names, []) AS names FROM d LEFT JOIN a USING (doc_id))"
_MISSING = ", ".join(f"CASE WHEN NOT list_contains(names, '{n}') THEN 'Missing top-level section ''{n}''' END" for n in sr.ORDER)
_CONTAINS = ", ".join(f"CASE WHEN list_contains(names, '{n}') THEN 'contains_{n.lower()}' END" for n in sr.ORDER)
_ODD = "list_filter(names, lambda x: NOT list_contains([" + ", ".join(f"'{n}'" for n in sr.ORDER) + "], x))"


@derived("rule_19_document_order", TREES, _TOP + f""" SELECT doc_id, array_to_string(names, '|') AS actual_order, concat_ws('|', {_CONTAINS}, 'correct_top_level_order', CASE WHEN len({_ODD}) = 0 THEN 'no_unexpected_top_level_sections' END) AS followed,
  concat_ws('|', {_MISSING}, CASE WHEN len({_ODD}) > 0 THEN 'Unexpected top-level sections: ' || array_to_string({_ODD}, ', ') END) AS issues FROM t""")
def document_order(i):
    o = sr.check_order(i)
    return o.select("doc_id", F.array_join("actual_order", "|").alias("actual_order"), F.array_join("followed", "|").alias("followed"), F.array_join("issues", "|").alias("issues"))


@derived("win_18_strict_order", TREES, _TOP + """ SELECT doc_id, bool_and(coalesce(k > before, true)) AS in_order FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM
  (SELECT s.doc_id, list_position(['INTRODUCTION', 'METHODS', 'RESULTS', 'DISCUSSION', 'CONCLUSIONS'], norm) AS k, min(start_position) AS pos FROM s GROUP BY s.doc_id, norm) WHERE k IS NOT NULL AND k > 0) GROUP BY doc_id""".replace("SELECT doc_id, bool_and", "SELECT doc_id, coalesce(in_order, true) AS in_order FROM d LEFT JOIN (SELECT doc_id, bool_and", 1) + ") AS x USING (doc_id)")
def strict_order(i):
    o = sr.check_order(i, strict_order=True)
    return o.select("doc_id", F.array_contains("followed", "correct_top_level_order").alias("in_order"))


def _validated(i: DataFrame) -> tuple[DataFrame, DataFrame]:
    styled = _styled(i.withColumns({"f": F.lit(0), "z": F.lit(0), "b": F.lit(1)})).select("id", "ranges", "extracted_text")
    s = i.join(styled, "id")
    return sr.validate_sections(s), sr.check_order(s)


# Documents of the five expected sections: every third is complete, the next has a slanted heading, and the last lacks its results.
COMPLETE = "SELECT c_custkey AS doc_id, CAST(j AS BIGINT) AS id, CASE j WHEN 1 THEN 'INTRODUCTION' WHEN 2 THEN 'METHODS' WHEN 3 THEN 'RESULTS' WHEN 4 THEN 'DISCUSSION' ELSE 'CONCLUSIONS' END AS name, CAST(1 AS INT) AS level, CAST(NULL AS BIGINT) AS parent_id, CAST(j * 10 AS INT) AS start_position, CAST(CASE WHEN c_custkey % 3 = 1 AND j = 2 THEN 2 ELSE 0 END AS INT) AS f FROM {customer} CROSS JOIN (SELECT r_regionkey + 1 AS j FROM {region}) AS r WHERE c_custkey % 3 < 2 OR j <> 3"


@derived("agg_13_document_validity", COMPLETE, "SELECT DISTINCT doc_id, doc_id % 3 = 0 AS valid FROM i")
def document_validity(i):
    keyed = i.withColumn("look", F.col("id") * 10 + F.col("f"))
    looks = _styled(keyed.select(F.col("look").alias("id"), "name", "level", "f").distinct().withColumns({"z": F.lit(0), "b": F.lit(1)}))
    s = keyed.join(looks.select(F.col("id").alias("look"), "ranges", "extracted_text"), "look")
    return sr.validate_documents(sr.validate_sections(s), sr.check_order(s))


@derived("snk_04_validation_report", TREES, _HIER + """, x AS (SELECT * FROM r JOIN s USING (doc_id, id)) SELECT doc_id, id AS section_id, trim(name) AS heading_text, lv AND pa AS hierarchy_valid, concat_ws(' | ', CASE WHEN lv THEN 'correct_level' END, CASE WHEN pa THEN 'correct_parent' END) AS hierarchy_followed, false AS document_valid FROM x""")
def validation_report(i):
    return sr.report_csv(*_validated(i)).select("doc_id", "section_id", "heading_text", "hierarchy_valid", "hierarchy_followed", "document_valid")


# Guidelines of each family.
FAMILIES = "('H1', 5), ('H2', 5), ('H3', 6), ('H4', 6), ('HIER', 2), ('ORD', 7)"
_G = "g(ord, key, gid, guideline, reason) AS (VALUES " + ", ".join(f"({k}, " + ", ".join("'" + x.replace("'", "''") + "'" for x in g) + ")" for k, g in enumerate(sr.GUIDELINES)) + ")"


KEYS = "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'h4_bold' WHEN 1 THEN ' font MUST be bold ' WHEN 2 THEN 'Font is italic' ELSE p_name END AS key FROM {part}"


@derived("join_07_guideline_lookup", KEYS,
         "SELECT k, CASE k % 4 WHEN 0 THEN 'H4-05' WHEN 1 THEN 'H1-04' WHEN 2 THEN 'H1-05' ELSE '' END AS guideline_id, CASE k % 4 WHEN 0 THEN 'Font is not bold' WHEN 1 THEN 'Font is not bold' WHEN 2 THEN 'Font is italic' ELSE key END AS reason FROM i")
def guideline_lookup(i):
    return sr.resolve_guidelines(i).select("k", "guideline_id", "reason")


@derived("dim_10_guidelines", KEYS, f"SELECT (SELECT count(*) FROM i WHERE CASE k % 4 WHEN 0 THEN 'H4' WHEN 1 THEN 'H1' WHEN 2 THEN 'H1' END = family) AS reasons, family, n::BIGINT AS n, n::BIGINT AS numbers, n::BIGINT AS keys, family || '-' || lpad(n || '', 2, '0') AS last FROM (VALUES {FAMILIES}) AS t(family, n)")
def guidelines(i):
    """Each family is numbered from 1 without gaps, and no key is used twice; reasons are the keys of the input that are of the family."""
    used = sr.resolve_guidelines(i).groupBy(F.substring_index("guideline_id", "-", 1).alias("family")).agg(F.count("*").alias("reasons"))
    g = sr.guidelines(i.sparkSession).withColumn("family", F.substring_index("id", "-", 1))
    return g.groupBy("family").agg(F.count("*").alias("n"), F.countDistinct("id").alias("numbers"), F.countDistinct("key").alias("keys"), F.max("id").alias("last")).join(used, "family", "left").fillna(0, "reasons")


@derived("prj_06_guideline_rows", TREES, _HIER + f""", {_G}, o AS (SELECT doc_id, id, unnest(list_filter([CASE WHEN lv THEN 'correct_level' END, CASE WHEN pa THEN 'correct_parent' END], lambda x: x IS NOT NULL)) AS key FROM r)
  SELECT doc_id, id AS section_id, gid AS guideline_id, '' AS reason FROM o JOIN g USING (key)""")
def guideline_rows(i):
    rows = sr.guideline_rows(*_validated(i))
    return rows.filter("group_ord = 3 and followed = 1").select("doc_id", F.col("section_ord").alias("section_id"), "guideline_id", "reason")


@derived("snk_05_list_to_string", "SELECT o_custkey AS k, o_orderpriority AS x FROM {orders}", "SELECT k, string_agg(x, ' | ' ORDER BY x) AS joined FROM i GROUP BY k")
def lists(i):
    return i.groupBy("k").agg(F.array_sort(F.collect_list("x")).alias("x")).select("k", tx.list_to_string(F.col("x")).alias("joined"))


@derived("snk_07_sheet_names", "SELECT p_partkey AS k, '/a/b/' || CASE p_partkey % 3 WHEN 0 THEN p_name || '.v1.docx' WHEN 1 THEN 'x[' || p_size || ']:y?*.docx' ELSE 'a very long name that does not fit ' || p_size || '.docx' END AS path FROM {part}",
         "SELECT k, left(CASE k % 3 WHEN 0 THEN p_name || '.v1' WHEN 1 THEN 'x_' || p_size || '__y__' ELSE 'a very long name that does not fit ' || p_size END, 31) AS sheet FROM i JOIN part ON k = p_partkey")
def sheet_names(i):
    return i.select("k", tx.sheet_name(F.col("path")).alias("sheet"))


@derived("snk_08_unique_sheet_names", "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END || ' sheet of parts of that brand' AS name FROM {part}",
         """, r AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY doc_id) - 1 AS k FROM i) SELECT doc_id, CASE WHEN k = 0 THEN name ELSE left(name, (31 - length('_' || k))::INT) || '_' || k END AS sheet FROM r""")
def unique_sheets(i):
    return sr.unique_sheet_names(i).select("doc_id", "sheet")


# Titles

ABBREV = "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'Use of MRI and COVID-19 tests ' || c_custkey || ' in the U.S. by mRNA' WHEN 1 THEN 'THE RESULTS of H2O and p53' WHEN 2 THEN 'plain words' ELSE 'TNF-α and β-actin in IL-6' END AS title FROM {customer}"


@derived("rule_21_abbreviations", ABBREV, "SELECT k, CASE k % 4 WHEN 0 THEN 'MRI@7|COVID-19@15|U.S.@' || (38 + length(k || '')) || '|mRNA@' || (46 + length(k || '')) WHEN 1 THEN 'H2O@15|p53@23' WHEN 2 THEN '' ELSE 'TNF-α@0|β-actin@10|IL-6@21' END AS found FROM i")
def abbreviations(i):
    a = i.select("k", tt.abbreviations_udf()("title").alias("a"))
    return a.select("k", F.array_join(F.transform("a", lambda x: F.concat(x["text"], F.lit("@"), x["start"].cast("string"))), "|").alias("found"))


@derived("agg_15_distinct_abbreviations", ABBREV, "SELECT sum(n)::BIGINT AS n FROM (SELECT CASE k % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 3 END AS n FROM i)")
def distinct_abbreviations(i):
    a = i.select(F.array_distinct(F.transform(tt.abbreviations_udf()("title"), lambda x: x["text"])).alias("a"))
    return a.agg(F.sum(F.size("a")).cast("bigint").alias("n"))


EXPANSIONS = "SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'the role of mRNA in ' || p_name || ' by WHO' WHEN 1 THEN 'state-of-the-art care' ELSE 'of α and beta' END AS e FROM {part}"


@derived("fn_18_capitalize_expansion", EXPANSIONS, """SELECT k, CASE k % 3 WHEN 0 THEN 'The Role of mRNA in ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' by WHO' WHEN 1 THEN 'State-of-the-Art Care' ELSE 'Of α and Beta' END AS shown FROM i JOIN part ON k = p_partkey""")
def capitalize_expansion(i):
    return i.select("k", tt.capitalize_expansion(F.col("e")).alias("shown"))


CASED = "SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'Care For ' || lower(c_mktsegment) || ' With Us: Before And During A Time: x' WHEN 1 THEN 'Fine Words Only' ELSE 'From the Start Of It' END AS title FROM {customer}"


@derived("fn_19_fix_title_case", CASED, "SELECT k, CASE k % 3 WHEN 0 THEN 'Care for ' || lower(c_mktsegment) || ' With us: Before and During a Time: x' WHEN 1 THEN title ELSE 'From the Start of it' END AS fixed FROM i JOIN customer ON k = c_custkey")
def fixed_titles(i):
    return i.select("k", tt.fix_title_case(F.col("title")).alias("fixed"))


@derived("prj_07_title_case_edits", CASED, """SELECT k, part::INT AS part, affected_text, suggested_replacement FROM (SELECT k, unnest([0, 0, 1, 1]) AS part, unnest(['For', 'Us', 'And', 'A']) AS affected_text, unnest(['for', 'us', 'and', 'a']) AS suggested_replacement FROM i WHERE k % 3 = 0
  UNION ALL SELECT k, unnest([0, 0]), unnest(['Of', 'It']), unnest(['of', 'it']) FROM i WHERE k % 3 = 2)""")
def title_edits(i):
    return tt.title_case_edits(i, "k", "title").select(F.col("key").alias("k"), "part", "affected_text", "suggested_replacement")


VERDICTS = "SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'BMI' ELSE 'QoL' || s_suppkey END AS term, s_suppkey % 4 <> 3 AS valid_abbreviation, 'quality of life' AS expanded_form, CASE s_suppkey % 4 WHEN 0 THEN ' BMI' WHEN 1 THEN 'NA' ELSE 'QoL' END AS equivalent_in_common_list FROM {supplier}"


@derived("flt_07_abbreviation_edits", VERDICTS, "SELECT k, term AS affected_text, CASE WHEN k % 4 = 1 THEN 'Uncommon Abbreviations not allowed in titles' ELSE 'kindly use this standard form' END AS reason, CASE WHEN k % 4 = 1 THEN 'Quality of Life' ELSE 'QoL' END AS suggested_replacement FROM i WHERE k % 4 IN (1, 2)")
def abbreviation_edits(i):
    return tt.abbreviation_edits(i).select("k", "affected_text", "reason", "suggested_replacement")


@derived("set_02_title_checks", VERDICTS, "SELECT k, 'title_abbreviation_constraint' AS guideline_id, CASE WHEN k % 4 = 1 THEN 'Quality of Life' ELSE 'QoL' END AS suggested_replacement FROM i WHERE k % 4 IN (1, 2) UNION ALL SELECT k, 'title_case_constraint', 'of' FROM i")
def title_checks(i):
    a = tt.abbreviation_edits(i).select("k", "guideline_id", "suggested_replacement")
    t = tt.title_case_edits(i.select("k", F.lit("Care Of Us").alias("t")), "k", "t").filter("affected_text = 'Of'").select(F.col("key").alias("k"), F.lit("title_case_constraint").alias("guideline_id"), "suggested_replacement")
    return a.unionByName(t)


RESPONSES = """SELECT o_orderkey AS k, 'Here: [{"guideline_followed": Flase, "reason": "brace } in \\\\" string", "edit_score": ' || (o_orderkey % 10) || ',}] and {bad: True, ' || '"n": {"x": 1}} {"open": 1' AS response FROM {orders}"""


@derived("fn_53_json_objects", RESPONSES, """SELECT k, 2::INT AS n, '{bad: True, "n": {"x": 1}}' AS second FROM i""")
def json_objects(i):
    return i.select("k", tt.json_objects_udf()("response").alias("o")).select("k", F.size("o").alias("n"), F.get("o", F.lit(1)).alias("second"))


@derived("fn_54_parsed_objects", RESPONSES, "SELECT k, 0::INT AS pos, false AS guideline_followed, (k % 10)::DOUBLE AS edit_score FROM i UNION ALL SELECT k, 1, NULL, NULL FROM i")
def parsed_objects(i):
    return tt.parse_objects(i, "response", "guideline_followed boolean, reason string, edit_score double").select("k", "pos", "parsed.guideline_followed", "parsed.edit_score")


@derived("fn_55_payload", "SELECT n_nationkey AS k, n_name AS user_text FROM {nation}", """SELECT k, '{"model":"m","temperature":0,"messages":[{"role":"system","content":"check"},{"role":"assistant","content":"Okay"},{"role":"user","content":"' || user_text || '"}]}' AS payload FROM i""")
def payload(i):
    return i.select("k", tt.chat_payload(F.lit("check"), F.col("user_text"), "m").alias("payload"))


@derived("win_17_merged_ranges", "SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS run, l_returnflag AS style FROM {lineitem}",
         """, g AS (SELECT *, CASE WHEN style = lag(style) OVER w THEN 0 ELSE 1 END AS new FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY run)), c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY run) AS range FROM g)
  SELECT doc_id, range::BIGINT AS range, (min(run) * 3 - 3)::INT AS start_char, (max(run) * 3)::INT AS end_char, repeat('abc', count(*)) AS text, any_value(style) AS style FROM c GROUP BY doc_id, range""")
def merged_ranges(i):
    r = i.select("doc_id", F.lit(0).alias("span_start"), F.lit(999).alias("span_end"), F.lit(0).alias("idx"), "run", (F.col("run") * 3 - 3).alias("start_char"), (F.col("run") * 3).alias("end_char"), F.lit("abc").alias("text"), F.struct(F.col("style").alias("font_name")).alias("style"))
    return merge_ranges(r).select("doc_id", "range", "start_char", "end_char", "text", F.col("style.font_name").alias("style"))


# Sections of one document each: a heading level that has its rules, and where a style that is wrong shows.
@derived("rule_18_validated_sections", COMPLETE, "SELECT doc_id, id, f = 0 AS style_valid, true AS text_valid, true AS hierarchy_valid, f = 0 AS valid, CASE WHEN f = 2 THEN 'h1_font_name|h1_not_italic' ELSE '' END AS style_issues FROM i")
def validated_sections(i):
    keyed = i.withColumn("look", F.col("id") * 10 + F.col("f"))
    looks = _styled(keyed.select(F.col("look").alias("id"), "name", "level", "f").distinct().withColumns({"z": F.lit(0), "b": F.lit(1)}))
    s = sr.validate_sections(keyed.join(looks.select(F.col("id").alias("look"), "ranges", "extracted_text"), "look"))
    return s.select("doc_id", "id", "style_valid", "text_valid", "hierarchy_valid", "valid", F.array_join("style_issues", "|").alias("style_issues"))


@derived("rule_20_validated_documents", TREES, "SELECT DISTINCT doc_id, false AS valid, 5::BIGINT AS n FROM i")
def validated_documents(i):
    """No region has all five sections; each has its five nations."""
    validated, order = _validated(i)
    return sr.validate_documents(validated, order).join(validated.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id").select("doc_id", "valid", "n")


# Two sections METHODS and a subsection below the first: the last of a name is the expected parent.
TWINS = "SELECT c_custkey AS doc_id, CAST(j AS BIGINT) AS id, CASE WHEN j = 2 THEN 'Study Sample' ELSE 'Methods' END AS name, CAST(CASE WHEN j = 2 THEN 2 ELSE 1 END AS INT) AS level, CAST(CASE WHEN j = 2 THEN 1 END AS BIGINT) AS parent_id FROM {customer} CROSS JOIN (SELECT r_regionkey + 1 AS j FROM {region} WHERE r_regionkey < 3) AS r WHERE c_custkey % 2 = 0 OR j < 3"


@derived("join_06_last_parent_of_a_name", TWINS, "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Expected parent_id=3 (''METHODS''), found parent_id=1 (''Methods'')' ELSE '' END AS issues FROM i WHERE id = 2")
def last_parent(i):
    return sr.check_hierarchy(i).filter("id = 2").select("doc_id", F.array_join("hierarchy_issues", "|").alias("issues"))


@derived("join_05_hierarchy_of_sections", TWINS, "SELECT doc_id, id, CASE WHEN id = 2 AND doc_id % 2 = 0 THEN 'correct_level' ELSE 'correct_level|correct_parent' END AS followed FROM i")
def hierarchy_of_sections(i):
    none = F.array().cast(f"array<{sr.RANGE}>")
    s = sr.validate_sections(i.withColumns({"ranges": none, "extracted_text": F.col("name")}))
    return s.select("doc_id", "id", F.array_join("hierarchy_followed", "|").alias("followed"))


SHUFFLED = "SELECT c_custkey AS doc_id, CAST(j AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, 1 AS level, CASE j WHEN 1 THEN 'Results' WHEN 2 THEN 'Odd One' WHEN 3 THEN 'Methods' ELSE 'Other' END AS name, CAST(100 - j * 10 AS INT) AS start_position FROM {customer} CROSS JOIN (SELECT r_regionkey + 1 AS j FROM {region} WHERE r_regionkey < 4) AS r"


@derived("sort_05_by_start_position", SHUFFLED, "SELECT DISTINCT doc_id, 'OTHER|METHODS|ODD ONE|RESULTS' AS names FROM i")
def by_start_position(i):
    return sr.check_order(i).select("doc_id", F.array_join("actual_order", "|").alias("names"))


@derived("join_19_unexpected_sections", SHUFFLED, "SELECT DISTINCT doc_id, 'Missing top-level section ''INTRODUCTION''|Missing top-level section ''DISCUSSION''|Missing top-level section ''CONCLUSIONS''|Unexpected top-level sections: OTHER, ODD ONE' AS issues FROM i")
def unexpected_sections(i):
    return sr.check_order(i).select("doc_id", F.array_join("issues", "|").alias("issues"))


@derived("flt_09_first_and_body_style", STYLED, "SELECT id, CASE WHEN z < 6 THEN CASE f WHEN 0 THEN ' franklin  Gothic MEDIUM' WHEN 1 THEN 'Arial' END END AS first_font, CASE WHEN z <= 4 THEN 12.0 END::DOUBLE AS body_size FROM i")
def first_and_body_style(i):
    s = _styled(i)
    return s.select("id", F.get(sr.text_runs(F.col("ranges")), F.lit(0))["style"]["font_name"].alias("first_font"), sr.body_style(F.col("ranges"))["font_size"].alias("body_size"))
