"""Queries over citations, authors, journals, cached metadata and rebuilt references."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import citations as ct
from quire.operators import references as rf
from quire.plans.registry import derived, query, source, spread, table

# Citations whose parts are columns.
CITES = """SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CAST(1990 + l_orderkey % 30 AS STRING) AS y, CAST(l_partkey % 90 + 1 AS STRING) AS vol, CAST(l_suppkey % 12 + 1 AS STRING) AS iss,
  CAST(l_partkey % 400 + 1 AS STRING) AS p1, CAST(l_partkey % 400 + 9 AS STRING) AS p2, '10.1000/' || l_orderkey || '.' || l_linenumber AS doi FROM {lineitem}""".replace("STRING", "VARCHAR(20)")
CITED = "SELECT *, n || '. Doe J, Roe K. Study of part ' || p || '. J Test. ' || y || ';' || vol || '(' || iss || '):' || p1 || '-' || p2 || '. doi:' || doi || '.' AS ref FROM (" + CITES + ") AS c"


@derived("fn_43_page_info", CITED, "SELECT k, n, p, y AS year, vol AS volume, iss AS issue, p1 || '-' || p2 AS pages FROM i", heavy=True)
def page_info(i):
    return i.select("k", "n", "p", ct.page_info(F.col("ref")).alias("x")).select("k", "n", "p", "x.*")


@derived("fn_42_first_doi", CITED, "SELECT k, n, p, 'doi:' || doi AS found, doi AS bare, lower(doi) AS key FROM i", heavy=True)
def first_doi(i):
    found = ct.first_doi(F.col("ref"))
    return i.select("k", "n", "p", found.alias("found"), ct.normalize_doi(found).alias("bare"), ct.doi_key(found).alias("key"))


@derived("fn_45_normalize_doi", "SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'https://doi.org/' WHEN 1 THEN 'HTTP://DX.doi.org/' WHEN 2 THEN 'doi: ' WHEN 3 THEN 'http://doi.org/' WHEN 4 THEN ' ' ELSE '' END || '10.1000/Ab' || o_orderkey || ' ' AS doi FROM {orders}",
         "SELECT k, '10.1000/Ab' || k AS doi, '10.1000/ab' || k AS key FROM i")
def normalize_doi(i):
    return i.select("k", ct.normalize_doi(F.col("doi")).alias("doi"), ct.doi_key(F.col("doi")).alias("key"))


@derived("fn_40_parse_reference", CITED, "SELECT k, n, p, '' AS author, '' AS title, 'Doe J, Roe K. Study of part ' || p || '. J Test. ' || y || ';' || vol || '(' || iss || '):' || p1 || '-' || p2 AS numbers, doi FROM i", heavy=True)
def parse_reference(i):
    return i.select("k", "n", "p", ct.parse_reference(F.col("ref")).alias("x")).select("k", "n", "p", "x.author", "x.title", "x.numbers", "x.doi")


@derived("fn_40_parse_reference_split", CITED, "SELECT k, n, p, 'Doe J, Roe K' AS author, 'Study of part ' || p || '.' AS title, 'J Test. ' || y || ';' || vol || '(' || iss || '):' || p1 || '-' || p2 AS numbers, doi FROM i", heavy=True)
def parse_reference_split(i):
    return i.select("k", "n", "p", ct.parse_reference(F.col("ref"), compat=False).alias("x")).select("k", "n", "p", "x.author", "x.title", "x.numbers", "x.doi")


NUMBER_FORMS = "SELECT *, CASE p % 5 WHEN 0 THEN 'J Test. ' || y || ';' || vol || '(' || iss || '):' || p1 || '-' || p2 || '.' WHEN 1 THEN y || ';' || vol || '(' || iss || ')(suppl 1):' || p1 || '–' || p2 WHEN 2 THEN y || ';' || vol || ':e' || p1 WHEN 3 THEN y || ';' || vol || ':' || p1 ELSE 'no year;' || vol END AS s FROM (" + CITES + ") AS c"


@derived("fn_41_parse_numbers", NUMBER_FORMS, """SELECT k, n, p, CASE WHEN p % 5 = 4 THEN '' ELSE y END AS year, CASE WHEN p % 5 = 4 THEN '' ELSE vol END AS volume, CASE p % 5 WHEN 0 THEN iss WHEN 1 THEN iss || ' suppl 1' ELSE '' END AS issue,
  CASE p % 5 WHEN 0 THEN p1 || '-' || p2 WHEN 1 THEN p1 || '-' || p2 WHEN 3 THEN p1 ELSE '' END AS pages, CASE p % 5 WHEN 2 THEN 'e' || p1 ELSE '' END AS article_number FROM i""", heavy=True)
def parse_numbers(i):
    return i.select("k", "n", "p", ct.parse_numbers(F.col("s")).alias("x")).select("k", "n", "p", "x.*")


@derived("fn_44_separate_numbers", NUMBER_FORMS.replace("'J Test. ' || y", "'J Test ' || y"), f"SELECT k, n, p, CASE p % 5 WHEN 0 THEN y || ';' || vol || '(' || iss || '):' || p1 || '-' || p2 ELSE '{ct.NO_NUMBERS}' END AS numbers FROM i")
def separate_numbers(i):
    return i.select("k", "n", "p", ct.separate_numbers(F.col("s")).alias("numbers"))


@derived("fn_46_format_numbers", CITES, "SELECT k, n, p, CASE WHEN p % 7 = 0 THEN NULL ELSE CASE WHEN p % 7 = 1 THEN 'None' ELSE y END || ';' || vol || CASE WHEN p % 2 = 0 THEN '(' || iss || ')' ELSE '' END || CASE WHEN p % 3 = 0 THEN ':' || p1 || '-' || p2 ELSE ':e' || p1 END END AS text FROM i")
def format_numbers(i):
    year = F.expr("CASE p % 7 WHEN 0 THEN NULL WHEN 1 THEN '20 Mar' WHEN 2 THEN y || ' Dec' ELSE y END")
    x = F.struct(year.alias("year"), F.col("vol").alias("volume"), F.expr("CASE WHEN p % 2 = 0 THEN iss END").alias("issue"), F.expr("CASE WHEN p % 3 = 0 THEN p1 || '-' || p2 END").alias("pages"), F.expr("'e' || p1").alias("article_number"))
    return i.select("k", "n", "p", ct.format_numbers(x).alias("text"))


_AUTHORS = [("'Ana da Costa'", "da Costa A"), ("'Rui de Melo Pinto'", "Pinto RdeM"), ("'Pinto, Rui A'", "Pinto R A"), ("'  Mary   Ann Lee '", "Lee MA"), ("'Plato'", "Plato"), ("'Fernando Cezar‐dos‐Santos'", "Cezar-dos-Santos F"), ("'Vincent van der Berg'", "van der Berg V"), ("'Élan Été'", "Été É")]
AUTHORS = "SELECT c_custkey AS k, CASE c_custkey % 8 " + " ".join(f"WHEN {k} THEN {a}" for k, (a, _) in enumerate(_AUTHORS)) + " END AS author FROM {customer}"
_SHOWN = "CASE k % 8 " + " ".join(f"WHEN {k} THEN '{b}'" for k, (_, b) in enumerate(_AUTHORS)) + " END"


@derived("fn_47_format_author", AUTHORS, f"SELECT k, {_SHOWN} AS shown FROM i")
def format_author(i):
    return i.select("k", ct.format_authors(F.array("author")).alias("a")).select("k", F.expr("left(a, length(a) - 1)").alias("shown"))


@derived("agg_16_format_authors", "SELECT c_custkey AS k, c_custkey % 9 AS n FROM {customer}", "SELECT k, CASE WHEN n = 0 THEN '' WHEN n > 6 THEN 'A1 G, A2 G, A3 G, et al.' ELSE array_to_string(list_transform(range(1, n + 1), lambda x: 'A' || x || ' G'), ', ') || '.' END AS authors FROM i", heavy=True)
def format_authors(i):
    names = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest("n", F.lit(1))), lambda x: F.concat(F.lit("Given A"), x.cast("string")))).otherwise(F.array().cast("array<string>"))
    return i.select("k", ct.format_authors(names).alias("authors"))


@derived("fn_62_text_edit", "SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN ' old ' || p_name || ' to new ' || p_size || ' to b' WHEN 1 THEN 'together ' || p_name ELSE p_name || '  to  ' END AS s FROM {part}",
         "SELECT k, CASE k % 3 WHEN 0 THEN 'old ' || p_name END AS old_text, CASE k % 3 WHEN 0 THEN 'new ' || p_size || ' to b' END AS new_text FROM i JOIN part ON k = p_partkey")
def text_edit(i):
    return i.select("k", ct.split_change(F.col("s")).alias("x")).select("k", "x.old_text", "x.new_text")


@derived("win_16_merge_spans", "SELECT l_orderkey AS k, CAST(l_partkey % 50 AS INT) AS a, CAST(l_partkey % 50 + 1 + l_suppkey % 9 AS INT) AS z FROM {lineitem}",
         """, o AS (SELECT *, max(z) OVER (PARTITION BY k ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT DISTINCT k, a, z FROM i)),
  g AS (SELECT *, sum(CASE WHEN before IS NULL OR a >= before THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS grp FROM o)
  SELECT k, min(a) AS "start", max(z) AS "end" FROM g GROUP BY k, grp""")
def merged_spans(i):
    g = i.groupBy("k").agg(F.collect_list(F.struct(F.col("a").alias("start"), F.col("z").alias("end"))).alias("s"))
    return g.select("k", F.explode(ct.merge_spans(F.col("s"))).alias("x")).select("k", "x.start", "x.end")


REF_TEXTS = "SELECT c_custkey AS doc_id, 'REFERENCES' || chr(10) || '1. First of ' || c_name || chr(10) || '2. A Reference to skip' || chr(10) || '3. Third' AS text FROM {customer}"


@derived("flt_03_reference_lines", REF_TEXTS, "SELECT doc_id, 1::INT AS ord, '1. First of ' || c_name AS actual_ref FROM i JOIN customer ON doc_id = c_custkey UNION ALL SELECT doc_id, 2, '3. Third' FROM i")
def reference_lines(i):
    return rf.reference_lines(i, "doc_id", "text")


@derived("flt_04_max_refs", REF_TEXTS, "SELECT doc_id, 1::INT AS ord, '1. First of ' || c_name AS actual_ref FROM i JOIN customer ON doc_id = c_custkey")
def max_refs(i):
    return rf.reference_lines(i, "doc_id", "text", max_refs=1)


@derived("src_05_json_elements", """SELECT c_custkey AS k, '{"file": "doc' || c_custkey || '.json", "Old References": "x", "References": ' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"1. ' || c_mktsegment || '"' END || '}' AS content FROM {customer}""",
         "SELECT 'doc' || k || '.json' AS file, CASE WHEN k % 3 = 0 THEN '' ELSE '1. ' || c_mktsegment END AS text FROM i JOIN customer ON k = c_custkey")
def json_elements(i):
    return rf.json_elements(i, "References")


# A journal list as text, from parts; every third title occurs twice.
JOURNALS = "SELECT p_partkey AS ord, 'Annals of part ' || (p_partkey - CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE 0 END) || '.' AS title, p_partkey AS id FROM {part}"
_RECORD = "'JrId: ' || id || chr(10) || 'JournalTitle: ' || title || chr(10) || 'MedAbbr: Ann Part ' || id || ' (Online)' || chr(10) || 'ISSN (Print): ' || chr(10) || 'no colon'"


def _records(i):
    """Records as files of one record each, parsed as rows; ord is the place in the list."""
    files = i.select(F.col("ord").alias("place"), F.expr(_RECORD.replace("chr(10)", "'\\n'")).alias("content"))
    return rf.parse_journals(files, keep=("place",)).select(F.col("place").alias("ord"), "record")


@derived("src_07_parse_journals", JOURNALS, "SELECT ord, id || '' AS jrid, title, 'Ann Part ' || id AS med_abbr, 3::INT AS n FROM i")
def parse_journals(i):
    m = F.col("record")
    return _records(i).select("ord", m["JrId"].alias("jrid"), m["JournalTitle"].alias("title"), m["MedAbbr"].alias("med_abbr"), F.size("record").alias("n"))


@derived("agg_14_journal_dimension", JOURNALS, "SELECT lower(replace(title, '.', '')) AS title_key, min(ord) AS ord, 'Ann Part ' || max(id) AS med_abbr FROM i GROUP BY title")
def journal_dimension(i):
    return rf.journal_dimension(_records(i)).select("title_key", "ord", "med_abbr")


WANTED = "SELECT s_suppkey AS k, CAST(s_suppkey % 3 AS INT) AS kind, 'Annals of part ' || (s_suppkey * 3) AS exact, 'nnals of part ' || (s_suppkey * 3) || '.' AS near FROM {supplier}"


@query("join_03_journal_lookup", f"WITH i AS ({WANTED}) SELECT k, 'annals of part ' || (k * 3) AS title_key, 'Ann Part ' || (k * 3) AS med_abbr FROM i WHERE kind < 2")
def journal_lookup(spark, sf_dir):
    """First name unknown; second exact (kind 0), near (kind 1) or unknown (kind 2)."""
    i = source(spark, sf_dir, WANTED)
    names = i.select("k", F.posexplode(F.array(F.lit("Unknown Journal"), F.expr("CASE kind WHEN 0 THEN exact WHEN 1 THEN near ELSE 'Nothing' END"))).alias("pos", "name"))
    return rf.find_journals(names, rf.journal_dimension(_records(spread(source(spark, sf_dir, JOURNALS)))), ["k"])


CACHE = "SELECT '10.1000/' || user_id AS doi, props AS metadata, event_type AS source, CAST(1 AS INT) AS success, ts AS updated_at, event_id FROM {events}"


@derived("snk_13_cache_upsert", CACHE, "SELECT doi, arg_max(event_id, event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY updated_at DESC, metadata DESC) AS r FROM i) WHERE r = 1 GROUP BY doi")
def cache_upsert(i):
    return rf.latest_metadata(i).select("doi", "event_id")


@derived("snk_13_cache_merge", CACHE, "SELECT doi, count(*) AS n, max(updated_at) AS updated_at FROM (SELECT doi, max(updated_at) AS updated_at FROM i GROUP BY doi) GROUP BY doi")
def cache_merge(i):
    merged = rf.merge_metadata(rf.latest_metadata(i.filter("event_id % 2 = 0")), i)
    return merged.groupBy("doi").agg(F.count("*").alias("n"), F.max("updated_at").alias("updated_at"))


STATUS = "SELECT event_id AS k, CAST(CASE event_id % 8 WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 503 WHEN 5 THEN 500 WHEN 6 THEN 418 ELSE 504 END AS INT) AS status, CASE WHEN event_id % 8 = 3 THEN '7' END AS retry_after, CAST(event_id % 5 AS INT) AS attempt, event_id % 8 <> 1 AS ok FROM {events}"


@derived("fn_60_http_outcome", STATUS, """SELECT k, CASE WHEN status = 200 AND ok THEN 'success' WHEN status = 200 THEN 'invalid_json' WHEN status = 404 THEN 'not_found' WHEN status = 418 OR attempt >= 3 THEN 'failed' ELSE 'retry' END AS outcome,
  CASE WHEN status IN (429, 500, 503, 504) AND attempt < 3 THEN CASE WHEN status = 429 THEN 7.0 ELSE least(pow(2, attempt), 30) END END::DOUBLE AS delay FROM i""")
def http_outcome(i):
    return i.select("k", rf.http_outcome(F.col("status"), F.col("retry_after"), F.col("attempt"), F.col("ok")).alias("x")).select("k", "x.outcome", "x.delay")


# Metadata in both layouts, and citations without DOI or metadata.
META = """SELECT o_orderkey AS k, o_orderkey % 4 AS kind, CASE o_orderkey % 4 WHEN 0 THEN 'openalex' WHEN 1 THEN 'crossref' END AS source,
  CASE o_orderkey % 4 WHEN 0 THEN '{"title": "GREAT Part n' || o_orderkey || '. a view", "authorships": [{"author": {"display_name": "Ana da Costa"}}, {"author": {"display_name": ""}}, {"author": {"display_name": "Rui Pinto"}}], "locations": [{"raw_source_name": null}, {"raw_source_name": " Annals of part 3. "}]}'
   WHEN 1 THEN '{"title": ["Small PART n' || o_orderkey || '"], "author": [{"given": "Mary Ann", "family": "Lee"}, {"given": "X"}], "container-title": ["Unknown Weekly"]}' END AS metadata,
  'Doe J. A part. J Test. 2020;5(2):11-19.' || CASE WHEN o_orderkey % 4 < 3 THEN ' doi:10.1000/X' || o_orderkey ELSE '' END AS ref FROM {orders}"""


@derived("fn_51_metadata_fields", META, """SELECT k, CASE kind WHEN 0 THEN 'GREAT Part n' || k || '. a view' WHEN 1 THEN 'Small PART n' || k ELSE '' END AS title, CASE kind WHEN 0 THEN 'Ana da Costa|Rui Pinto' WHEN 1 THEN 'Mary Ann Lee' ELSE '' END AS authors,
  CASE kind WHEN 0 THEN 'Annals of part 3.' WHEN 1 THEN 'Unknown Weekly' ELSE '' END AS journals FROM i""")
def metadata_fields(i):
    return rf.with_metadata_fields(i).select("k", "title", F.array_join("author_names", "|").alias("authors"), F.array_join("journal_names", "|").alias("journals"))


@query("rule_22_rebuilt_references", f"""WITH i AS ({META}) SELECT k AS doc_id, CASE kind WHEN 0 THEN '1. da Costa A, Pinto R. Great part n' || k || '. A view. Ann Part 3. 2020;5(2):11-19. https://doi.org/10.1000/X' || k || '.'
  WHEN 1 THEN '1. Lee MA. Small part n' || k || '. Unknown Weekly. 2020;5(2):11-19. https://doi.org/10.1000/X' || k || '.' ELSE '' END AS edited, CASE kind WHEN 3 THEN 'DOI' ELSE '' END AS missing, CASE kind WHEN 2 THEN '{rf.NO_METADATA}' ELSE '' END AS warnings FROM i""")
def rebuilt_references(spark, sf_dir):
    i = spread(source(spark, sf_dir, META))
    out = _rebuilt(spark, sf_dir, i, with_edits=False)
    return out.select("doc_id", "edited", F.array_join("missing_components", "|").alias("missing"), F.array_join("warnings", "|").alias("warnings"))


def _rebuilt(spark, sf_dir, i, with_edits):
    refs = i.select(F.col("k").alias("doc_id"), F.lit(1).alias("ord"), F.col("ref").alias("actual_ref"))
    meta = i.filter("kind < 2").select(F.concat(F.lit("10.1000/x"), F.col("k").cast("string")).alias("doi"), "metadata", "source", F.lit(True).alias("success"))
    return rf.rebuild(refs, meta, rf.journal_dimension(_records(spread(source(spark, sf_dir, JOURNALS)))), with_edits)


@query("fn_59_text_edits", f"WITH i AS ({META}) SELECT k AS doc_id, kind < 2 AS changed FROM i")
def text_edits(spark, sf_dir):
    """Spans of every edit reproduce its texts; documents without a rebuilt form have none."""
    out = _rebuilt(spark, sf_dir, source(spark, sf_dir, META), with_edits=True)
    fits = F.forall("text_edits", lambda e: (F.substr("original", e["original_position"]["start"] + 1, e["original_position"]["end"] - e["original_position"]["start"]) == e["original_text"])
                    & (F.substr("edited", e["edited_position"]["start"] + 1, e["edited_position"]["end"] - e["edited_position"]["start"]) == e["edited_text"]))
    return out.select("doc_id", ((F.size("text_edits") > 0) & fits).alias("changed"))


@derived("sort_07_first_doi_of_many", "SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, 'see 10.1000/b' || l_partkey || '; and doi:10.2000/a' || l_suppkey || '.' AS s FROM {lineitem}", "SELECT k, n, p, '10.1000/b' || p AS doi FROM i")
def first_of_many(i):
    return i.select("k", "n", "p", ct.first_doi(F.col("s")).alias("doi"))


@derived("src_07_journal_file", "SELECT n_nationkey AS k, n_name AS name FROM {nation}", "SELECT k, r::INT AS ord, CASE r WHEN 0 THEN name ELSE 'Second' END AS title, CASE r WHEN 0 THEN 3 ELSE 1 END::INT AS n FROM i, range(2) AS t(r)")
def journal_file(i):
    """Several records in a file: lines of dashes part them; empty values, lines without a colon and brackets go; the last key counts."""
    line = F.lit("\n" + "-" * 30 + "\n")
    content = F.concat(F.lit("JrId: 1\nJrId: 2\nJournalTitle: "), "name", F.lit(" (Online)\nMedAbbr: a: b\nNlmId:\nno colon"), line, F.lit("JournalTitle: Second"), line, F.lit(" \n"))
    rows = rf.parse_journals(i.select("k", content.alias("content")), keep=("k",))
    return rows.select("k", "ord", F.col("record")["JournalTitle"].alias("title"), F.size("record").alias("n"))


@query("join_04_cached_metadata", f"WITH i AS ({CITED}) SELECT i.k, i.n, i.p, CASE WHEN o_orderkey % 3 < 2 THEN o_orderpriority END AS metadata FROM i LEFT JOIN orders ON o_orderkey = i.k AND i.n = 1")
def cached_metadata(spark, sf_dir):
    refs = source(spark, sf_dir, CITED).select("k", "n", "p", ct.first_doi(F.col("ref")).alias("doi"))
    cache = table(spark, sf_dir, "orders").select(F.concat(F.lit("https://doi.org/10.1000/"), F.col("o_orderkey").cast("string"), F.lit(".1")).alias("doi"), F.col("o_orderpriority").alias("metadata"), F.lit("openalex").alias("source"), (F.col("o_orderkey") % 3 < 2).alias("success"))
    return rf.with_metadata(refs, cache).select("k", "n", "p", "metadata")


@derived("win_19_reference_ordinals", REF_TEXTS, "SELECT doc_id, '1. 1. First of ' || c_name AS shown FROM i JOIN customer ON doc_id = c_custkey UNION ALL SELECT doc_id, '2. 3. Third' FROM i")
def reference_ordinals(i):
    return rf.numbered(rf.reference_lines(i, "doc_id", "text")).select("doc_id", "shown")


# The edits of the two kinds of rebuilt references, in order, in SQL; their words are the same in every document but for its number.
REPORT_0 = ["'Doe J to 1. da Costa A, Pinto R. Great part n' || k", "' part to  view'", "' J Test to  Ann Part 3'", "'  to  https://'", "': to .org/'", "' to .'"]
REPORT_1 = ["'Doe J to 1'", "' A to  Lee MA. Small'", "' to n' || k", "' J Test to  Unknown Weekly'", "'  to  https://'", "': to .org/'", "' to .'"]
EDITS_OF = {0: REPORT_0, 1: REPORT_1}
_EDITED = " UNION ALL ".join(f"SELECT k AS doc_id, {p}::INT AS pos, 'Text Edit' AS kind, {d} AS detail FROM i WHERE kind = {kind}" for kind, rows in EDITS_OF.items() for p, d in enumerate(rows))


@query("snk_09_reference_report", f"WITH i AS ({META}) {_EDITED} UNION ALL SELECT k, 0, CASE kind WHEN 2 THEN 'Warning' ELSE 'Incomplete Component' END, CASE kind WHEN 2 THEN '{rf.NO_METADATA}' ELSE 'DOI' END FROM i WHERE kind >= 2")
def reference_report(spark, sf_dir):
    rows = rf.report_rows(_rebuilt(spark, sf_dir, source(spark, sf_dir, META), with_edits=True))
    return rows.select("doc_id", "pos", "kind", "detail")


_LINES = " UNION ALL ".join(f"SELECT k AS doc_id, {p}::INT AS pos, {p} = 0 AS original, {d} AS detail FROM i WHERE kind = {kind}" for kind, rows in EDITS_OF.items() for p, d in enumerate(rows))


@query("snk_10_edit_rows", f"WITH i AS ({META}) {_LINES} UNION ALL SELECT k, 0, true, '' FROM i WHERE kind >= 2 UNION ALL SELECT k, {rf.LAST}, false, '' FROM i")
def edit_rows(spark, sf_dir):
    rows = rf.edit_rows(_rebuilt(spark, sf_dir, source(spark, sf_dir, META), with_edits=True))
    return rows.select("doc_id", "pos", (F.col("original") != "").alias("original"), "detail")


@query("set_01_report_union", f"WITH i AS ({META}) SELECT kind_ord::INT AS kind_ord, k % 4 AS kind, count(*) AS n FROM (SELECT k, 0 AS kind_ord FROM i, range({len(REPORT_0)}) WHERE kind = 0 UNION ALL SELECT k, 0 FROM i, range({len(REPORT_1)}) WHERE kind = 1 UNION ALL SELECT k, 1 FROM i WHERE kind = 2 UNION ALL SELECT k, 2 FROM i WHERE kind = 3) GROUP BY ALL")
def report_union(spark, sf_dir):
    rows = rf.report_rows(_rebuilt(spark, sf_dir, source(spark, sf_dir, META), with_edits=True))
    return rows.groupBy("kind_ord", (F.col("doc_id") % 4).alias("kind")).agg(F.count("*").alias("n"))


@derived("sort_08_first_lines", REF_TEXTS, "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(range(2)) AS r FROM i) GROUP BY doc_id")
def first_lines(i):
    return rf.reference_lines(i, "doc_id", "text", max_refs=5).groupBy("doc_id").agg(F.count("*").alias("n"))


@derived("prj_05_field_access", META, "SELECT k, CASE kind WHEN 0 THEN '|Annals of part 3.' WHEN 1 THEN '|Unknown Weekly' ELSE '' END AS shown FROM i")
def field_access(i):
    """Fields of either layout, of missing metadata and of missing arrays."""
    f = rf.with_metadata_fields(i)
    return f.select("k", F.array_join(F.transform("journal_names", lambda x: F.concat(F.lit("|"), x)), "").alias("shown"))
