"""Invariants of section trees and goldens of single functions."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quire.functions import citations, lexicon, titles
from quire.functions import text as tx
from quire.operators import references, sections, sequences
from quire.functions import prompts
from quire.functions.similarity import best_name, name_similarity
from quire.sources import docx, providers, services, text_reader, workbook, writers
from quire.streaming import jobs
from quire.streaming.sections import stream_sections

WORDS = "METHODS|Results|Abstract|Introduction: we saw many things here and there in the land|REFERENCES|1. Doe J. A. 2019|Figure 1. x|Keywords: a; b; c|Funding: None.|plain words in a line|TABLE|Jane Doe, PhD, John Roe, MPH, Ann Poe|x@y.edu|ACKNOWLEDGMENTS|Highlights|- a bullet|2. Roe K. B. 2020 https://x.org|Title: A Study of the Long Name Here|\f|".split("|")


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("r")).first().r


def test_tree_invariants(spark):
    rng = random.Random(1)
    raw = [(i, "\n".join(rng.choice(WORDS) + ("\n" if rng.random() < 0.6 else "") for _ in range(rng.randint(0, 40)))) for i in range(300)]
    docs = spark.createDataFrame(raw + [(1000, None), (1001, "")], "doc_id bigint, raw string")
    blocks = text_reader.read_blocks(docs).select("doc_id", "idx", "text", "start", "end").collect()
    text, by_doc = {}, {}
    for b in sorted(blocks, key=lambda b: (b.doc_id, b.idx)):
        assert b.start == (len(text[b.doc_id]) + 1 if b.doc_id in text else 0) and b.end - b.start == len(b.text)
        text[b.doc_id] = (text[b.doc_id] + "\n" if b.doc_id in text else "") + b.text
    for s in sections.extract_sections(docs).collect():
        assert s.extracted_text == text[s.doc_id][s.start_position : s.end_position]
        assert 0.15 <= s.confidence <= 0.97 and s.uncertain == (s.confidence < 0.7)
        by_doc.setdefault(s.doc_id, []).append(s)
    assert set(by_doc) == set(text)
    for d, found in by_doc.items():
        found.sort(key=lambda s: s.id)
        level = {s.id: s.level for s in found}
        assert all(s.parent_id is None or level[s.parent_id] < s.level for s in found)
        top = [s for s in found if s.level == 1]
        assert top[0].start_position == 0 and top[-1].end_position == len(text[d])
        assert all(b.start_position == a.end_position + 1 for a, b in zip(top, top[1:]))
    standard = sections.standard_documents(sections.extract_sections(docs))
    assert standard.columns[1:15] == sections.ELEMENTS


@pytest.mark.parametrize("text, numbers", [
    ("2020;5(2):11-19.", ("2020", "5", "2", "11-19", "")), ("2020;5(2)(suppl 1):3-4", ("2020", "5", "2 suppl 1", "3-4", "")), ("2020;5:e77", ("2020", "5", "", "", "e77")), ("2020;5:77", ("2020", "5", "", "77", "")),
    ("J. 1999; 12A (x(y)z) : S1 - S9", ("1999", "12A", "x(y)z", "S1-S9", "")), ("no year", ("", "", "", "", "")), ("", ("", "", "", "", "")), (None, ("", "", "", "", "")), ("2020", ("2020", "", "", "", "")),
])
def test_numbers(spark, text, numbers):
    assert tuple(one(spark, text, citations.parse_numbers)) == numbers


@pytest.mark.parametrize("text, info", [("2020;5(2):11-19.", ("2020", "5", "2", "11-19")), ("2020;5(2)", (None,) * 4), ("12 Mar;:", ("12 Mar", None, None, None)), ("2020 Dec 20; 7 Suppl 2 : e5", ("2020 Dec 20", "7 Suppl 2", None, "e5"))])
def test_page_info(spark, text, info):
    assert tuple(one(spark, text, citations.page_info)) == info


@pytest.mark.parametrize("s, ends", [("made in the U.S.", False), ("an end.", True), ("a, ", True), ("really?", True), ("none", False), ("", False)])
def test_sentence_ends(spark, s, ends):
    assert one(spark, s, tx.ends_like_sentence) is ends


def test_et_al(spark):
    r = one(spark, "[3] Kuypers KP, Ng L, et al. Many questions. J Test. 2019;33(9):1-7. doi:10.1000/ab", lambda c: citations.parse_reference(c, compat=False))
    assert (r.author, r.title, r.numbers, r.doi) == ("Kuypers KP, Ng L, et al.", "Many questions.", "J Test. 2019;33(9):1-7", "10.1000/ab")


def test_lexicon_is_complete():
    assert [sum(len(set(names)) for names in d.values()) for d in (lexicon.NAMES, lexicon.SUBSECTION_NAMES)] == [274, 49]
    assert len(lexicon.TYPE_OF) == 323


def test_abbreviation_overlaps():
    assert [a["text"] for a in titles.abbreviations_of("SARS-CoV-2 and IL-6 in the U.S. by mRNA")] == ["SARS-CoV-2", "IL-6", "U.S.", "mRNA"]
    assert titles.json_objects_of('a {"x": "}"} b {"y": {"z": 1}} {') == ['{"x": "}"}', '{"y": {"z": 1}}']


def test_text_edits_rebuild_positions():
    for e in references.text_edits("A quick brown fox", "A slow brown  fox jumps"):
        o, n = e["original_position"], e["edited_position"]
        assert "A quick brown fox"[o["start"] : o["end"]] == e["original_text"] and "A slow brown  fox jumps"[n["start"] : n["end"]] == e["edited_text"]


def test_name_similarity(spark):
    def by_table(a, b):
        line = [0] * (len(b) + 1)
        for x in a:
            before = line[:]
            for j, y in enumerate(b, 1):
                line[j] = before[j - 1] + 1 if x == y else max(before[j], line[j - 1])
        return 200.0 * line[-1] / (len(a) + len(b)) if a or b else 100.0

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    pairs = [(word(rng.randint(0, 70)), word(rng.randint(0, 62))) for _ in range(200)] + [("", ""), ("ist of figures", "list of figures"), ("a" * 62, "a" * 62), (None, "a")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", name_similarity(F.col("a"), F.col("b")).alias("s"), name_similarity(F.col("a"), F.col("b"), 70.0).alias("t")).collect()
    for r in rows:
        expected = None if r.a is None or r.b is None else by_table(r.a, r.b)
        assert r.s == (expected if expected is None else pytest.approx(expected)) and r.t == (None if expected is None else pytest.approx(expected if expected >= 70 else 0.0))
    near = one(spark, "list of figurs", lambda c: best_name(c, {"x": ["figure", "list of figures"], "y": ["list of figures", "tables"]}, 88))
    assert near.kind == "x" and near.score == pytest.approx(200 * 14 / 29) and one(spark, "elsewhere", lambda c: best_name(c, {"x": ["figure"]}, 88)) is None


def test_warnings_are_observed(spark):
    docs = spark.createDataFrame([(1, "A Title of Some Length\n\nINTRODUCTION\n\nSome words here."), (2, "REFERENCES\n\n1. Doe J. A part. J Test. 2019;5(2):1-9.\n\n2. Roe K. A part. J Test. 2020;6(1):2-9.")], "doc_id bigint, raw string")
    told, seen = sections.observed(sections.sections_in_documents(text_reader.read_blocks(docs), text_mode=True))
    assert {r.doc_id: [w.code for w in r.warnings] for r in told.collect()} == {1: ["no-references"], 2: []}
    assert {k: v for k, v in seen.get.items() if v} == {"documents": 2, "with-warnings": 1, "no-references": 1}


def test_docx_modes_and_errors():
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    data = docx.make_docx([(run("kept") + "<w:ins>" + run(" new") + "</w:ins><w:del><w:r><w:delText> old</w:delText></w:r></w:del><w:odd/>", {})])
    assert [b["text"] for b in docx.read_document(data)["blocks"]] == ["kept new"]
    assert [b["text"] for b in docx.read_document(data, "reject")["blocks"]] == ["kept old"]
    assert docx.read_document(data)["warnings"] == ["unhandled elements: odd"]
    assert docx.read_document(b"no zip")["error"].startswith("BadZipFile") and docx.read_document(None)["error"]


def test_style_chains_end(spark):
    rows = [(1, "a", "b", None), (1, "b", "a", None), (1, "c", "d", None), (1, "d", None, "x"), (1, "e", "missing", "y")]
    got = docx.resolve_inheritance(spark.createDataFrame(rows, "doc_id int, style_id string, based_on string, font string"), "font")
    assert {r.style_id: r.font for r in got.collect()} == {"a": None, "b": None, "c": "x", "d": "x", "e": "y"}


def test_duplicate_chains_with_loops(spark):
    rows = [(1, 1, 2), (1, 2, 3), (1, 3, None), (1, 4, 5), (1, 5, 4)]
    rows += [(1, 6, 4), (1, 7, 6), (1, 8, 8), (2, 9, 1), (2, 1, 77)]
    got = {(r.doc_id, r.id): r.duplicate_of for r in sequences.chain_ends(spark.createDataFrame(rows, "doc_id int, id int, duplicate_of int")).collect()}
    assert got == {(1, 1): 3, (1, 2): 3, (1, 4): 4, (1, 5): 5, (1, 6): 4, (1, 7): 4, (1, 8): 8, (2, 9): 77, (2, 1): 77}


def test_long_chains(spark):
    rows = [(d, i, i + 1 if i < 1000 else None, f"v{d}" if i == 1000 else None) for d in (1, 2) for i in range(1001)]
    df = spark.createDataFrame(rows, "doc_id int, id int, duplicate_of int, v string")
    assert {(r.doc_id, r.duplicate_of) for r in sequences.chain_ends(df).collect()} == {(1, 1000), (2, 1000)}
    got = sequences.inherited(df, "id", "duplicate_of", "v").collect()
    assert len(got) == 2002 and {(r.doc_id, r.v) for r in got} == {(1, "v1"), (2, "v2")}


def test_sinks_and_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"METHODS\n\nbody \xff text")
    (tmp_path / "in" / "b.pdf").write_bytes(b"x")
    files = text_reader.read_texts(spark, str(tmp_path / "in"))
    assert files.count() == 1 and "body" in files.first().raw
    rows = spark.createDataFrame([("/x/doc one.docx", 1, "a, \"b\"")], "document string, n int, t string")
    writers.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv")).first().t == 'a, "b"'
    writers.write_sheets(rows, str(tmp_path / "sheets"))
    assert (tmp_path / "sheets" / "sheet=doc one").exists()
    query = stream_sections(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert {r.section_type for r in spark.read.parquet(str(tmp_path / "out")).collect()} & {"methods"}


def test_cache_table(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS quire_cache")
    writers.create_cache(spark, "quire_cache", buckets=8, path=str(tmp_path / "cache"))
    row = lambda doi, meta, day: (doi, meta, True, None, "openalex", f"2020-01-{day:02d} 00:00:00", f"2020-01-{day:02d} 00:00:00")
    schema = "doi string, metadata string, success boolean, error string, source string, created_at string, updated_at string"
    changes = lambda *rows: spark.createDataFrame(rows, schema).withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    files = lambda: {f.relative_to(tmp_path).parts[1]: f.name for f in (tmp_path / "cache").rglob("part-*")}
    assert writers.upsert_cache(spark, "quire_cache", changes(row("a", "1", 1), row("a", "2", 2), *(row(f"k{i}", "1", 1) for i in range(60)))) == 8
    before = files()
    assert len(before) == 8 and writers.upsert_cache(spark, "quire_cache", changes(row("k7", "9", 3))) == 1  # one bucket is written, seven stay
    assert sum(before[k] != name for k, name in files().items()) == 1
    assert {r.doi: r.metadata for r in spark.table("quire_cache").collect()} == {"a": "2", **{f"k{i}": "9" if i == 7 else "1" for i in range(60)}}
    assert writers.upsert_cache(spark, "quire_cache", changes(row("k7", "9", 3)).limit(0)) == 0
    asked = writers.lookup_cache(spark, "quire_cache", spark.createDataFrame([(1, "k7"), (2, "none"), (3, None), (4, "k7")], "n int, doi string"))
    assert {r.n: r.metadata for r in asked.collect()} == {1: "9", 2: None, 3: None, 4: "9"}
    few = writers.cached_rows(spark, "quire_cache", ["k7"])
    assert [r.metadata for r in few.collect()] == ["9"] and writers.cached_rows(spark, "quire_cache", []).count() == 0
    assert len(few.inputFiles()) == 1  # of eight
    spark.sql("DROP TABLE quire_cache")


def test_metadata_source(spark, tmp_path):
    services.register(spark)
    spark.createDataFrame([("10.1/0",), ("10.1/2",), ("10.1/3",), (None,), ("",)], "key string").coalesce(1).write.parquet(str(tmp_path / "keys"))
    asked = json.dumps([["openalex", "quire.plans.storage_queries:stand_in_open"], ["crossref", "quire.plans.storage_queries:stand_in_second"]])
    read = lambda **o: spark.read.format("quire_metadata").options(services=asked, wait="0", **o).load(str(tmp_path / "keys"))
    assert {(r.key, r.source, r.success, r.error) for r in read().collect()} == {("10.1/0", "openalex", True, None), ("10.1/2", "crossref", True, None), ("10.1/3", None, False, "crossref_http_418"), (None, None, False, None), ("", None, False, None)}
    began = time.monotonic()
    assert read(rate="4").count() == 5 and time.monotonic() - began >= 1.0  # five calls, the first at once


def test_workbook_sink(spark, tmp_path):
    services.register(spark)
    books = spark.createDataFrame([("a/b", b"1"), ("c", b"2"), ("d", None)], "book string, content binary").repartition(3)
    save = lambda df, mode="append": df.write.format("quire_workbooks").mode(mode).save(str(tmp_path / "out"))
    held = lambda: {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir() if not f.name.startswith("_")}
    save(books)
    assert held() == {"a_b.xlsx": b"1", "c.xlsx": b"2", "d.xlsx": b""}
    broken = F.udf(lambda b: b if b != "c" else 1 / 0)("book")
    for bad in (books.withColumn("book", broken), books.withColumn("book", F.lit("same"))):  # a task fails, and two files of one name
        with pytest.raises(Exception):
            save(bad)
        assert held() == {"a_b.xlsx": b"1", "c.xlsx": b"2", "d.xlsx": b""}
    save(books.filter("book = 'c'").withColumn("content", F.lit(b"3")), "overwrite")
    assert held() == {"c.xlsx": b"3"}


def test_a_thousand_jobs_pend_at_once(spark, tmp_path):
    folder = tmp_path / "marks"
    folder.mkdir()

    def submit(payload):
        (folder / payload).touch(exist_ok=False)  # each is submitted once, whatever happens later
        return payload

    def state(job):
        kind, waited = int(job) % 4, time.time() - (folder / job).stat().st_mtime
        return ("RUNNING", None) if kind == 3 or waited < 2 else ("failed", "no") if kind == 2 else ("Done", "r" + job)

    requests = spark.createDataFrame([(str(i), str(i)) for i in range(1000)] + [("n", None)], "key string, payload string")
    began = time.monotonic()
    stream = None
    where = str(tmp_path / "jobs")
    requests.write.parquet(f"{where}/requests")
    first = jobs.job_outcomes(spark.readStream.schema("key string, payload string").parquet(f"{where}/requests"), submit, state, timeout=8, interval=0.5)
    stream = first.writeStream.format("parquet").option("path", f"{where}/outcomes").option("checkpointLocation", f"{where}/state").trigger(processingTime="200 milliseconds").start()
    while not (stream.lastProgress and stream.lastProgress["stateOperators"][0]["numRowsTotal"] == 1000):  # all of them, on four cores
        assert stream.isActive and time.monotonic() - began < 120
        time.sleep(0.1)
    stream.stop()
    out = jobs.run_jobs(spark, requests, where, submit, state, timeout=8, interval=0.5)  # goes on after the stop
    got = {r.key: (r.outcome, r.response) for r in out.collect()}
    assert len(got) == out.count() == 1001 and got["n"] == (None, None)
    assert all(got[str(i)] == (("done", f"r{i}"), ("done", f"r{i}"), ("failed", None), ("timeout", None))[i % 4] or i % 4 == 2 and got[str(i)] == ("failed", "no") for i in range(1000))
    assert time.monotonic() - began < 250  # one after the other, the jobs alone would wait 1,000 times


def test_list_is_fetched_once(spark, tmp_path):
    path, calls = str(tmp_path / "list.txt"), []

    def fetch(where):
        calls.append(where)
        (tmp_path / "list.txt").write_text("JrId: 1\nJournalTitle: A")

    with pytest.raises(FileNotFoundError):
        providers.list_file(spark, path)
    for _ in range(2):
        files = providers.list_file(spark, path, fetch)
        assert [r.record["JournalTitle"] for r in references.parse_journals(files).collect()] == ["A"]
    assert calls == [path]


def test_retries_and_polling():
    waits = []
    answers = iter([(429, {"Retry-After": "99"}, ""), (503, {}, ""), (200, {}, '{"a": 1}')])
    assert providers.ask("k", "openalex", lambda _: next(answers), sleep=waits.append) == ({"a": 1}, None) and waits == [30.0, 2.0]
    broken = iter([ConnectionError(), ConnectionError(), TimeoutError()])

    def call(_):
        raise next(broken)

    assert providers.ask("k", "crossref", call, sleep=lambda _: None) == (None, "crossref_timeout")
    states = iter([("RUNNING", None), ("done", "r")])
    assert providers.poll(lambda p: "job", lambda j: next(states), "p", sleep=lambda _: None) == ("done", "r")
    assert providers.poll(lambda p: None, lambda j: ("done", "r"), "p") == ("no_job", None)
    clock = iter([0, 1, 400])
    assert providers.poll(lambda p: "job", lambda j: ("?", None), "p", clock=lambda: next(clock), sleep=lambda _: None) == ("timeout", None)


def test_workbooks(spark):
    rows = spark.createDataFrame([(1, "S&1", 1, "a <b> \x01", None), (1, "S&1", 0, None, "z"), (2, None, 0, "", " two ")], "book int, sheet string, n int, x string, y string")
    books = workbook.workbooks(rows, "book", "sheet", ["n"], ["x", "y"])
    cells = {(r.book, r.sheet, r.row, r.column): r.text for r in workbook.workbook_cells(books).collect()}
    assert cells == {(1, "S&1", 1, 0): "x", (1, "S&1", 1, 1): "y", (1, "S&1", 2, 1): "z", (1, "S&1", 3, 0): "a <b> ", (2, "Sheet", 1, 0): "x", (2, "Sheet", 1, 1): "y", (2, "Sheet", 2, 0): "", (2, "Sheet", 2, 1): " two "}
    assert workbook.workbooks(rows.limit(0), "book", "sheet", ["n"], ["x"]).count() == 0
    assert [workbook.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and workbook.read_cells(None) == []


def test_prompts():
    text = prompts.prompt("title", {"a": "b"}, {"x": "y"})
    assert "- a: b" in text and "- x -> y" in text and '"edit_score": double' in text and len(prompts.TASKS) == 9


def test_report_rows_compute_results_once(spark):
    """A union of four selections computed each result four times."""
    docs = spark.createDataFrame([(1, 1, "a b", "a c", ["x"], []), (2, 1, "a", "", [], ["DOI"]), (3, 1, "a", "a", [], [])], "doc_id bigint, ord int, original string, edited string, warnings array<string>, missing_components array<string>")
    results = docs.withColumn("text_edits", references.edits_column(F.col("original"), F.col("edited")))
    for rows, want in (
        (references.report_rows(results), {(1, 0, 0, " b to  c"), (1, 1, 0, "x"), (2, 2, 0, "DOI"), (3, 3, 0, "No Edits")}),
        (references.edit_rows(results).withColumn("kind_ord", F.lit(0)), {(1, 0, 0, " b to  c"), (2, 0, 0, ""), (3, 0, 0, "")} | {(k, 0, references.LAST, "") for k in (1, 2, 3)}),
    ):
        assert {(r.doc_id, r.kind_ord, r.pos, r.detail) for r in rows.collect()} == want
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_edit_spans_are_those_of_difflib(spark):
    import difflib
    import re

    rng = random.Random(3)
    pairs = [tuple(" ".join(rng.choice(["a", "b", "c,", "é.", "x;y", "dd"]) for _ in range(rng.randint(1, 30))) for _ in "xy") for _ in range(200)] + [("", "a"), ("a", ""), ("x  y", "x\ty z"), ("𝔸 b", "b 𝔸 c")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "k int, a string, b string").withColumn("e", references.edits_column(F.col("a"), F.col("b")))
    for r in df.collect():
        words = [re.findall(r"\w+|[^\w\s]", t) for t in (r.a, r.b)]
        tags = [t for t, *_ in difflib.SequenceMatcher(None, *words, autojunk=False).get_opcodes() if t != "equal"] if r.a and r.b else []
        assert [e.edit_type for e in r.e] == [{"replace": "R", "delete": "U", "insert": "M"}[t] for t in tags]
        for e in r.e:
            assert r.a[e.original_position.start : e.original_position.end] == e.original_text and r.b[e.edited_position.start : e.edited_position.end] == e.edited_text


def test_sentence_case_keeps_every_character(spark):
    """Texts are cut at sentences, no longer into characters; what is between stays."""
    import re

    rng = random.Random(5)
    for t in ["", " ab. cd", "ab.\u00a0 cd!e ?f? g", "A. B. C", ". a", "é. ñ b. c"] + ["".join(rng.choice("aB.!? \té1") for _ in range(40)) for _ in range(20)]:
        low = t.lower()
        want = re.sub(r"\A[a-z]|(?<=[.!?])\s+[a-z]", lambda m: m[0].upper(), low)
        assert one(spark, t, tx.sentence_case) == want


def test_sections_are_dealt_by_counted_tasks(spark):
    """Lines and blocks were shuffled into parts whose number did not follow from the texts, so that tasks grew with them."""
    import re

    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("METHODS\n\n"), F.repeat(F.lit("words and more "), 20_000)).alias("raw"))
    n = text_reader.text_tasks(docs)
    assert n == -(-40 * (9 + 300_000 + 64) // text_reader.CHARS) > 4
    plan = sections.extract_sections(docs)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\), (\w+)", plan) == [(str(n), "REPARTITION_BY_NUM")] * 2


def test_rules_share_sorts(spark):
    """A sort holds pages of a task's memory and copies its rows: there were 25, and one window had a function for each use of a look back."""
    import re

    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("METHODS\n\nwords").alias("raw"))
    plan = sections.extract_sections(docs)._jdf.queryExecution()
    windows = re.findall(r"(?m)^.*\bWindow \[.*$", plan.optimizedPlan().toString())
    assert len(windows) > 40 and max(w.count("windowspecdefinition(") for w in windows) <= 8
    assert 5 < len(re.findall(r"\bSort \[", plan.executedPlan().toString())) <= 14


@pytest.mark.parametrize("name", ["flt_05_top_level_sections", "snk_01_section_json", "snk_03_document_json", "agg_09_unlabeled_warnings"])
def test_texts_are_made_in_counted_tasks(spark, name):
    """All texts were made in the one task that reads a small file, and held there by the shuffle's writer."""
    from quire.plans.all_queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [c_custkey") + plan.count("RepartitionByExpression [p_partkey") == 1


def test_runs_so_far(spark):
    """run_so_far() is islands() without a look ahead: the same start, and in a run's last row the same length."""
    rnd = random.Random(3)
    rows = [(d, i, rnd.random() < 0.6, rnd.random() < 0.7) for d in range(60) for i in range(12) if d % 3 or rnd.random() < 0.9]
    df = spark.createDataFrame(rows, "doc_id int, idx int, f boolean, o boolean")
    out = sequences.run_so_far(sequences.islands(df, "f", "run", of=F.col("f") & F.col("o")), F.col("f"), F.col("f") & F.col("o"), "since").collect()
    assert all(r.since == (r.run.start if r.f and r.run.start is not None and r.run.start <= r.idx else None) for r in out)
    assert {r.run.start for r in out if r.f and r.idx == r.run.last and r.run.start is not None} and len(out) == len(rows)


def test_white_space_class(spark):
    """The short class is the list of characters."""
    df = spark.range(1, 0x10000).filter("id NOT BETWEEN 55296 AND 57343").select(F.udf(chr, "string")("id").alias("c"))
    assert sorted(r.c for r in df.filter(F.col("c").rlike(rf"^[{tx.WS}]\z")).collect()) == sorted(tx.WS_CHARS)


def test_several_jobs_are_waited_for_at_once(spark):
    jobs_in = spark.createDataFrame([("a",), (None,), ("b",)], "payload string").coalesce(1)
    asked = providers.job_provider(lambda p: p, lambda job: ("RUNNING" if job == "b" else "DONE", job.upper()), timeout=0.02, interval=0.01, at_once=3)
    assert [tuple(r) for r in asked(jobs_in).collect()] == [("a", "done", "A"), (None, None, None), ("b", "timeout", None)]


@pytest.mark.parametrize("name", ["agg_16_format_authors", "fn_61_similarity", "src_10_job_states"])
def test_small_files_with_heavy_rows_are_spread(spark, name):
    """A file of one split kept one core busy."""
    from quire.plans.all_queries import QUERIES

    assert "Repartition" in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_citations_are_searched_once_for_each_part(spark):
    """A citation went through fourteen regular expressions; those that are left give the same parts as the rules in Python."""
    import re

    year = r"(?:18|19|20|21)\d{2}"
    doi = r"(?i)\b(?:https?://doi\.org/|doi:\s*)?(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"
    numbers = rf"\.\s*{year}\s*;\s*\d+[A-Za-z]?(?:\s*\([^)]*\))*(?:\s*:\s*[A-Za-z]{{0,10}}?\d+(?:\s*[-–—]\s*[A-Za-z]{{0,10}}?\d+)?)?\.?\s*\Z"

    def parts(c, compat):
        text = re.sub(r"^\s*(?:\[\d+\]|\(\d+\)|\d+[.)])\s*", "", re.sub("[‐‒–—−]", "-", " ".join(c.split())))
        found, bare = re.search(doi, text), ""
        if found:
            bare, text = re.sub(r"[.,;)\]}]+\Z", "", found[1]), re.sub(r"[ .,;]+\Z", "", text[: text.index(found[0])])
        if compat:
            n = text.strip() if re.search(rf"(?i)^.+?{numbers}", text, re.A) else ""
            rest = "" if n else text
        else:
            hit = re.search(rf"(?i)^(?:.*[.?!]\s+)?([^.]+{numbers})", text, re.A)
            n = hit[1].strip() if hit else ""
            rest = text[: len(text) - len(n)].strip() if n else text
        hit = re.search(r"(?i)^(.+?\bet al\.?)\s+(.+)\Z", rest) or re.search(r"^([^.]+?)\.\s+(.+)\Z", rest)
        return (hit[1].strip(), hit[2].strip(), n, bare) if hit else ("", rest, n, bare)

    rng = random.Random(7)
    some = ["Doe J", "Roe K, Poe L", ". ", ".", "; ", ";", ":", " ", "  ", "\t", "\n", " ", "et al", "et al.", "ET AL. ", "meet al", " doi:", "DOI: ", "https://doi.org/", "10.1000/ab", "10.1000/AB.c;", "x10.1000/ab",
            "10.12/", "1. ", "[12] ", "(3) ", "2019", ". 2020;5(2):11-19", ". 2020;5(2)(suppl 1):e3–4.", "J Test", "–", "é", "? ", "10.1000/ab)]", ","]
    df = spark.createDataFrame([("".join(rng.choice(some) for _ in range(rng.randint(0, 12))),) for _ in range(3000)], "c string")
    for compat in (True, False):
        made = df.select("c", citations.parse_reference(F.col("c"), compat).alias("x"))
        for r in made.collect():
            assert tuple(r.x)[:4] == parts(r.c, compat), r.c
        assert len(re.findall(r"regexp_\w+\(|RLIKE", made._jdf.queryExecution().optimizedPlan().toString())) <= 9


def test_workbooks_are_streamed(spark):
    """A workbook's rows met in one array of the JVM and one list of Python, and all of its cells were read into another."""
    rows = spark.range(20_000).select((F.col("id") % 2).alias("book"), F.when(F.col("id") % 4 < 2, "b").otherwise("a").alias("sheet"), (-F.col("id")).alias("n"), F.concat(F.lit("<é "), "id").alias("x"))
    books = workbook.workbooks(rows, "book", "sheet", ["n"], ["n", "x"])
    assert "collect_list" not in books._jdf.queryExecution().optimizedPlan().toString()
    cells = workbook.workbook_cells(books).filter("column = 1").groupBy("book", "sheet", "row").agg(F.first("text").alias("t"), F.count("*").alias("k")).collect()
    places = {(b, s): [x for x in range(19_999, -1, -1) if x % 2 == b and (x % 4 < 2) == (s == "b")] for b in (0, 1) for s in "ab"}
    want = {(b, s, i): f"<é {x}" for (b, s), ids in places.items() for i, x in enumerate(ids, 2)} | {(b, s, 1): "x" for b, s in places}
    assert {(r.book, r.sheet, r.row): r.t for r in cells} == want and all(r.k == 1 for r in cells)
    file = workbook.Book()
    file.begin("s")
    for i in range(1000):
        file.add([[{"text": str(i)}]])
    runs = workbook.cells_of(file.content())
    assert next(runs)["text"] == "0" and len(list(runs)) == 999  # one after the other


def test_files_are_moved_and_read_by_folders(spark, tmp_path):
    """The driver moved every file by itself, and Spark's reader began a task for every 32 of them."""
    services.register(spark)
    rows = spark.range(300).select(F.col("id").cast("string").alias("book"), F.concat(F.lit("té "), "id").cast("binary").alias("content"))
    save = lambda df, mode="append": df.write.format("quire_workbooks").option("suffix", ".txt").option("folders", 3).mode(mode).save(str(tmp_path / "out"))
    read = lambda: {r.path.rsplit("/", 1)[1]: r.raw for r in text_reader.read_texts(spark, str(tmp_path / "out"), folders=True).collect()}
    want = {f"{i}.txt": f"té {i}" for i in range(300)}
    save(rows.repartitionById(3, services.folder_number(F.concat("book", F.lit(".txt")), 3)))
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == ["files-0", "files-1", "files-2"] and read() == want
    assert text_reader.read_texts(spark, str(tmp_path / "out"), folders=True).rdd.getNumPartitions() == 4  # the folders, and the files beside them
    save(rows.filter("book < 7").withColumn("content", F.lit(b"new")).repartition(3))  # several tasks to a folder that is there
    assert read() == want | {f"{i}.txt": "new" for i in range(7)}
    for bad in (rows.withColumn("book", F.lit("same")).coalesce(1), rows.withColumn("book", F.lit("same")).repartition(3)):
        with pytest.raises(Exception):
            save(bad)
        assert len(read()) == 300
    save(rows.filter("book = '5'"), "overwrite")
    assert read() == {"5.txt": "té 5"}
    (tmp_path / "out" / "b.TEXT").write_bytes(b"\xff")
    (tmp_path / "out" / "c.pdf").write_bytes(b"x")
    assert read() == {"5.txt": "té 5", "b.TEXT": "�"}


def test_sections_are_compared_whole(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(rng.randint(4, 9))) for _ in range(n))
    same, one_end, other_end, start, shared = prose(460), prose(1500), prose(1500), prose(460), prose(1500)
    assert len(same) > 2500 and len(start) > 2500
    cases = {1: (same + " " + one_end, same + " " + other_end), 2: (start + " " + shared, prose(460) + " " + shared), 3: (same, same + " " + one_end)}
    rows, at = [], 0
    for d, texts in cases.items():
        for k, t in enumerate(texts):
            rows.append((d, k + 1, None, "methods", "", 1, k, k, at, at + len(t), t, 0.9, [], None))
            at += len(t) + 1
    schema = "doc_id int, id int, parent_id int, section_type string, name string, level int, start_block int, end_block int, start_position int, end_position int, extracted_text string, confidence double, evidence array<string>, flags map<string,string>"
    got = {(r.doc_id, r.id): r.duplicate_of for r in sections.add_duplicates(spark.createDataFrame(rows, schema)).collect()}
    # one beginning and different rests are no copies; different beginnings and one rest are; of a text and a longer one, the longer is kept
    assert got == {(1, 1): None, (1, 2): None, (2, 1): None, (2, 2): 1, (3, 1): 2, (3, 2): None}


def test_words_are_counted_without_arrays(spark):
    """The shares and counts are those of a test of each word, and none is tested by itself."""
    rng = random.Random(7)
    parts = ["The", "of", "OF", "a", "Ab", "ab", "12", "1st", "A1", "(The", "the.", "Über", "\u01c5x", "\U0001d400b", "x\U0001d400", "\U0001f600", "As", "asset", "V", "vs", "vs.", "-", "ſ", "İn", "\u00aa"]
    rows = [("".join(rng.choice(parts) + rng.choice([" ", "\n", "\u00a0", "\x1f", "  ", "", "\u200b"]) for _ in range(rng.randint(0, 12))),) for _ in range(500)] + [("",), (None,)]
    tokens = tx.words(F.col("s"))
    content = F.filter(tokens, lambda w: w.rlike(r"\p{L}") & ~F.lower(w).isin(tx.STOP_WORDS))
    upper = F.size(F.filter(content, lambda w: w.rlike(r"^\p{Lu}")))
    want = F.when(F.size(content) > 0, upper / F.size(content)).otherwise(0.0)
    df = spark.createDataFrame(rows, "s string").select("s", want.alias("a"), tx.title_case_ratio(F.col("s")).alias("b"), F.size(tokens).alias("m"), tx.count_of_words(F.col("s")).alias("n"))
    assert df.filter("not (a <=> b and m <=> n)").collect() == []
    docs = spark.createDataFrame([(1, "A Title")], "doc_id int, raw string")
    plan = text_reader.read_blocks(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("filter(split(" in line and "tc_ratio" in line for line in plan.splitlines())


def test_windows_of_a_document_share_an_operator(spark):
    """A window operator copies each row twice: windows over a whole document had operators of their own."""
    from quire.operators.marks import _doc, _order

    rows = spark.createDataFrame([(d, i, i % 3) for d in range(5) for i in range(9)], "doc_id int, idx int, v int")
    own = rows.select("*", F.max("v").over(_doc()).alias("a"), F.sum("v").over(_order()).alias("b"))
    assert own._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    assert {r.a for r in own.collect()} == {2}


def test_long_texts_are_not_normalised(spark):
    longest = max(lexicon.TYPE_OF, key=len)
    texts = [longest, "xviii. " + longest.upper() + ":", "XVIII) " + longest, "xxviiii. " + longest, "(a) " + longest, "\ufb01 " * 40, longest + " and more words", "word " * 18, "12.1 METHODS", "1 " * 90 + "methods", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, s string")
    want = [(lambda n: n in lexicon.TYPE_OF)(r.n) for r in df.select("k", lexicon.normalize(F.col("s"))["norm"].alias("n")).orderBy("k").collect()]
    got = [r.m is not None for r in lexicon.add_match(df, F.col("s"), "m").orderBy("k").collect()]
    assert got == want and sum(want) >= 4
    assert one(spark, "word " * 18, lambda c: c.rlike(lexicon.TOO_MANY_LETTERS)) and not one(spark, "XVIIII) " + longest, lambda c: c.rlike(lexicon.TOO_MANY_LETTERS))
