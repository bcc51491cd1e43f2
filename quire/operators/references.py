"""Bibliographies: journal names, cached metadata, rebuilt citations and their differences."""

from __future__ import annotations

import difflib
import re
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.citations import clean, doi_key, first_doi, format_authors, format_numbers, normalize_doi, page_info
from quire.functions.text import let, lines, normalize_journal_name, sentence_case, strip
from quire.partitions import tasks_of

# Fixed values.
OPENALEX = "title string, authorships array<struct<author:struct<display_name:string>>>, locations array<struct<raw_source_name:string>>"
CROSSREF = "title array<string>, author array<struct<given:string,family:string>>, `container-title` array<string>"
JOURNAL_FIELDS = {"jrid": "JrId", "med_abbr": "MedAbbr", "issn_print": "ISSN (Print)", "issn_online": "ISSN (Online)", "iso_abbr": "IsoAbbr", "nlm_id": "NlmId"}
NO_METADATA = "OpenAlex metadata unavailable; input fields were used where possible."
RETRIED = (429, 500, 502, 503, 504)
EDITS = "array<struct<original_text:string,edited_text:string,original_position:struct<start:int,end:int>,edited_position:struct<start:int,end:int>,edit_type:string>>"


def json_elements(docs: DataFrame, element: str, content: str = "content") -> DataFrame:
    """file and text of the element of JSON documents whose key contains ``element``; the last such key counts, null is ''."""
    parsed = docs.withColumn("__m", F.from_json(content, "map<string,string>"))
    keys = F.filter(F.map_entries("__m"), lambda e: F.contains(e["key"], F.lit(element)))
    return parsed.select(F.col("__m")["file"].alias("file"), F.coalesce(F.try_element_at(keys, F.lit(-1))["value"], F.lit("")).alias("text"), (F.size(keys) > 0).alias("found")).filter("found").drop("found")


def reference_lines(docs: DataFrame, doc_id: str, text: str, max_refs: int | None = None) -> DataFrame:
    """doc_id, ord (from 1) and actual_ref: the lines of reference sections, without those that contain the word reference."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("p", "actual_ref")).filter(~F.lower("actual_ref").contains("reference"))
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("p"))).drop("p")
    return rows if max_refs is None else rows.filter(F.col("ord") <= max_refs)


def parse_journals(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns, ord (the place in the file) and record (a map): records between lines of dashes, "key: value" lines; the last of
    equal keys counts. A list in many files, or a file per record, is parsed in parallel."""
    records = files.select(*keep, F.posexplode(F.split(content, r"\n-{20,}\n")).alias("ord", "r")).filter(strip(F.col("r")) != "")
    pairs = F.transform(F.filter(F.transform(lines(F.col("r")), strip), lambda x: x.contains(":")), lambda x: F.struct(
        strip(F.substring_index(x, ":", 1)).alias("key"), strip(F.regexp_replace(strip(F.substr(x, F.instr(x, ":") + 1)), r"\s*\([^)]*\)", "")).alias("value")))
    pairs = F.filter(pairs, lambda e: e["value"] != "")
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))
    return records.select(*keep, "ord", last.alias("record")).filter(F.size("record") > 0)


def journal_dimension(records: DataFrame) -> DataFrame:
    """title_key, ord and fields: the last record of a title counts, at the place of its first."""
    fields = [F.coalesce(F.try_element_at("record", F.lit(v)), F.lit("")).alias(k) for k, v in JOURNAL_FIELDS.items()]
    rows = records.select(normalize_journal_name(F.try_element_at("record", F.lit("JournalTitle"))).alias("title_key"), "ord", F.struct(*fields).alias("f")).filter("title_key <> ''")
    return rows.groupBy("title_key").agg(F.min("ord").alias("ord"), F.max_by("f", "ord").alias("f")).select("title_key", "ord", "f.*")


def find_journals(names: DataFrame, journals: DataFrame, key: list[str], tasks: int | None = None) -> DataFrame:
    """names: key columns, pos, name. For each key the journal of the first name that is known: an exact title, else the first title
    that is the name and at most two characters around it. With ``tasks`` the result is dealt by key to that many.

    The near match is an equi-join too: titles without one or two of their outer characters."""
    wanted = names.select(*key, "pos", normalize_journal_name(strip(F.col("name"))).alias("n")).filter("n <> ''")
    cut = [(a, b) for a in range(3) for b in range(3) if 0 < a + b < 3]
    trimmed = F.array_distinct(F.array(*[F.substr("title_key", F.lit(a + 1), F.greatest(F.length("title_key") - (a + b), F.lit(0))) for a, b in cut]))
    form = lambda n, near, rank: F.struct(n.alias("n"), F.lit(near).alias("near"), rank.cast("bigint").alias("rank"))
    forms = F.concat(F.array(form(F.col("title_key"), 0, F.lit(-1))), F.transform(trimmed, lambda n: form(n, 1, F.col("ord"))))
    titles = journals.select(F.explode(forms).alias("x"), "med_abbr", "title_key").select("x.*", "med_abbr", "title_key").filter("n <> ''")
    found = wanted.join(titles, "n")
    found = found if tasks is None else found.repartition(tasks, *key)
    return found.groupBy(*key).agg(F.min_by(F.struct("title_key", "med_abbr"), F.struct("pos", "near", "rank")).alias("j")).select(*key, "j.title_key", "j.med_abbr")


def latest_metadata(rows: DataFrame) -> DataFrame:
    """The cache after upserts: of each doi the row of the latest updated_at, ties by the greater metadata."""
    return rows.groupBy("doi").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "doi"]), F.struct("updated_at", "metadata")).alias("r")).select("doi", "r.*")


def merge_metadata(cache: DataFrame, changes: DataFrame) -> DataFrame:
    """Cache rows replaced or joined by changes (latest of each doi)."""
    new = latest_metadata(changes)
    return cache.join(new.select("doi"), "doi", "left_anti").unionByName(new, allowMissingColumns=True)


def with_metadata(refs: DataFrame, cache: DataFrame, doi: str = "doi") -> DataFrame:
    """refs with metadata and source of the cache's row of the same DOI (case does not count); nulls where there is none or it failed."""
    known = cache.filter("success and metadata is not null and source is not null").select(doi_key(F.col("doi")).alias("__k"), "metadata", "source")
    return refs.withColumn("__k", doi_key(F.col(doi))).join(known, "__k", "left").drop("__k")


def numbered(refs: DataFrame) -> DataFrame:
    """Adds shown: the reference with its number in the document in front."""
    return refs.withColumn("shown", F.concat(F.col("ord").cast("string"), F.lit(". "), F.col("actual_ref")))


def http_outcome(status: Column, retry_after: Column, attempt: Column, valid_json: Column, max_attempts: int = 3, cap: float = 30.0) -> Column:
    """outcome (success, invalid_json, not_found, retry or failed) and delay in seconds of a metadata request."""
    retry = status.isin(*RETRIED)
    delay = F.least(F.coalesce(retry_after.try_cast("double"), F.pow(F.lit(2.0), attempt)), F.lit(cap))
    outcome = (
        F.when((status == 200) & valid_json, "success").when(status == 200, "invalid_json").when(status == 404, "not_found")
        .when(retry & (attempt < max_attempts), "retry").otherwise("failed")
    )
    return F.struct(outcome.alias("outcome"), F.when(outcome == "retry", delay).alias("delay"))


def with_metadata_fields(df: DataFrame) -> DataFrame:
    """Adds title, author_names and journal_names from metadata and source: two layouts."""
    a, b = F.from_json("metadata", OPENALEX), F.from_json("metadata", CROSSREF)
    some = lambda c: F.filter(c, lambda x: x.isNotNull() & (x != ""))
    open_, cross = F.contains("source", F.lit("openalex")), F.contains("source", F.lit("crossref"))
    df = df.withColumn("__a", F.when(open_, a)).withColumn("__b", F.when(cross & ~open_, b))
    names_a = some(F.transform("__a.authorships", lambda x: x["author"]["display_name"]))
    full = F.filter("__b.author", lambda x: x["given"].isNotNull() & x["family"].isNotNull())
    names_b = F.transform(full, lambda x: F.concat_ws(" ", x["given"], x["family"]))
    none = F.array().cast("array<string>")
    return df.select(
        "*", F.coalesce("__a.title", F.get("__b.title", F.lit(0)), F.lit("")).alias("title"), F.coalesce(names_a, names_b, none).alias("author_names"),
        F.coalesce(some(F.transform("__a.locations", lambda x: clean(x["raw_source_name"]))), some(F.transform("__b.container-title", clean)), none).alias("journal_names"),
    ).drop("__a", "__b")


def opcodes(a: Sequence, b: Sequence) -> list[tuple[str, int, int, int, int]]:
    """The steps from one sequence to the other that difflib finds without junk; equal stretches are left out."""
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    return [o for o in m.get_opcodes() if o[0] != "equal"]


#: Steps depend only on which words are equal. Those of patterns that came lately are kept.
_steps = lru_cache(maxsize=20_000)(opcodes)
_WORD = re.compile(r"\w+|[^\w\s]")
_TYPES = {"replace": "R", "delete": "U", "insert": "M"}


def edit_spans(original: str, edited: str) -> list[tuple[int, int, int, int, str]]:
    """What changes from one text to the other: runs of words and punctuation, as start and end in both texts and a type. R: replaced,
    M: missing before, U: unnecessary before."""
    words = [_WORD.findall(t) for t in (original, edited)]
    numbers: dict[str, int] = {}
    steps = _steps(*(tuple([numbers.setdefault(w, len(numbers)) for w in some]) for some in words))
    if not steps:
        return []
    starts: list[list[int]] = []
    for t, some in zip((original, edited), words):
        at, place = 0, []
        for w in some:  # only white space is between words
            at = t.index(w, at)
            place.append(at)
            at += len(w)
        starts.append(place)

    def span(k: int, i: int, j: int, n: int) -> tuple[int, int]:
        at = starts[k]
        if i < j:
            return at[i], at[j - 1] + len(words[k][j - 1])
        return (at[i],) * 2 if i < len(at) else (n, n)

    out = []
    for tag, i1, i2, j1, j2 in steps:
        (s, e), (u, v) = span(0, i1, i2, len(original)), span(1, j1, j2, len(edited))
        while s > 0 and u > 0 and original[s - 1].isspace() and original[s - 1] == edited[u - 1]:
            s, u = s - 1, u - 1
        out.append((s, e, u, v, _TYPES[tag]))
    return out


def text_edits(original: str, edited: str) -> list[dict]:
    """edit_spans() with the texts."""
    return [{"original_text": original[s:e], "edited_text": edited[u:v], "original_position": {"start": s, "end": e}, "edited_position": {"start": u, "end": v}, "edit_type": kind} for s, e, u, v, kind in edit_spans(original, edited)]


def edits_column(original: Column, edited: Column) -> Column:
    """text_edits() of two columns; none where either is empty. Python finds the spans; texts are cut out by Spark."""
    @F.arrow_udf("array<struct<s:int,e:int,u:int,v:int,kind:string>>")
    def spans(originals: pa.Array, edits: pa.Array) -> pa.Array:
        rows, ends = [], [0]
        for o, e in zip(originals.to_pylist(), edits.to_pylist()):
            if o and e:
                rows.extend(edit_spans(o, e))
            ends.append(len(rows))
        columns = list(zip(*rows)) or [()] * 5
        parts = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 4 + [pa.string()])], names=["s", "e", "u", "v", "kind"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)

    cut = lambda c, a, z: F.substr(c, a + 1, z - a)
    place = lambda a, z: F.struct(a.alias("start"), z.alias("end"))
    return F.transform(spans.asNondeterministic()(original, edited), lambda x: F.struct(
        cut(original, x["s"], x["e"]).alias("original_text"), cut(edited, x["u"], x["v"]).alias("edited_text"),
        place(x["s"], x["e"]).alias("original_position"), place(x["u"], x["v"]).alias("edited_position"), x["kind"].alias("edit_type"))).cast(EDITS)


def rebuild(refs: DataFrame, metadata: DataFrame, journals: DataFrame, with_edits: bool = True) -> DataFrame:
    """refs: doc_id, ord, actual_ref. Returns them with doi, edited, missing_components, warnings and text_edits.

    A citation without a DOI or without metadata keeps an empty edited form. Others are put together again from metadata, the
    journal list and their own numbers. Joins are on keys: the DOI, and journal titles. References are counted first, so that a task has a
    bounded number of them."""
    n = tasks_of(refs.select("doc_id"))
    r = refs.select("doc_id", "ord", clean(F.col("actual_ref")).alias("original"))
    r = r.withColumn("doi", normalize_doi(first_doi(F.col("original"))))
    r = with_metadata(r, metadata).repartition(n, "doc_id", "ord")
    r = with_metadata_fields(r)
    names = r.select("doc_id", "ord", F.posexplode("journal_names").alias("pos", "name"))
    r = r.join(find_journals(names, journals, ["doc_id", "ord"], n), ["doc_id", "ord"], "left")
    authors, title = format_authors(F.col("author_names")), clean(F.col("title"))
    authors = F.when(F.size("author_names") > 0, authors).otherwise("")
    journal = F.coalesce(F.nullif(clean(F.col("med_abbr")), F.lit("")), F.get("journal_names", F.lit(0)), F.lit(""))
    five = lambda x: F.struct(*[x[n].alias(n) for n in ("year", "volume", "issue", "pages")], F.lit(None).cast("string").alias("article_number"))
    numbers = F.coalesce(let(page_info(F.col("original")), lambda x: format_numbers(five(x))), F.lit(""))
    known = F.col("metadata").isNotNull()
    shown = lambda c: F.when(known & (F.col("doi") != ""), c).otherwise("")  # noqa: E731  parts of others are not asked for
    r = r.select("doc_id", "ord", "original", "doi", known.alias("known"), shown(authors).alias("a"), shown(title).alias("t"), shown(journal).alias("j"), shown(numbers).alias("n"))
    part = lambda c, text: F.when(c != "", text)
    parts = F.array_compact(F.array(part(F.col("a"), F.col("a")), part(F.col("t"), F.concat(sentence_case(F.col("t")), F.lit("."))), part(F.col("j"), F.concat("j", F.lit("."))),
                                    part(F.col("n"), F.concat("n", F.lit("."))), F.concat(F.lit("https://doi.org/"), "doi", F.lit("."))))
    edited = F.when((F.col("doi") != "") & F.col("known"), F.concat(F.col("ord").cast("string"), F.lit(". "), F.array_join(parts, " "))).otherwise("")
    missing = F.when(F.col("doi") == "", F.array(F.lit("DOI"))).when(~F.col("known"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(
        F.when(F.col("a") == "", F.lit("Authors")), F.when(F.col("t") == "", F.lit("Title")), F.when(F.col("j") == "", F.lit("Journal name/abbreviation")), F.when(F.col("n") == "", F.lit("Bibliographic numbers")))))
    warnings = F.when((F.col("doi") != "") & ~F.col("known"), F.array(F.lit(NO_METADATA))).otherwise(F.array().cast("array<string>"))
    r = r.select("doc_id", "ord", "original", "doi", edited.alias("edited"), missing.alias("missing_components"), warnings.alias("warnings"))
    return r.withColumn("text_edits", edits_column(F.col("original"), F.col("edited"))) if with_edits else r


def report_rows(results: DataFrame) -> DataFrame:
    """Workbook rows: one per text edit, then warnings, then incomplete components; a row that says so where there is nothing. A result's
    rows are made together, so that it is computed once."""
    row = lambda kind_ord, kind, detail, pos: F.struct(F.lit(kind_ord).alias("kind_ord"), pos.cast("int").alias("pos"), F.lit(kind).alias("kind"), detail.alias("detail"))
    edits = F.transform("text_edits", lambda e, i: row(0, "Text Edit", F.concat_ws(" to ", e["original_text"], e["edited_text"]), i))
    told = lambda c, kind_ord, kind: F.transform(c, lambda x, i: row(kind_ord, kind, x, i))
    rows = F.concat(edits, told("warnings", 1, "Warning"), told("missing_components", 2, "Incomplete Component"))
    none = F.array(row(3, "No Edits", F.lit("No Edits"), F.lit(0)))
    rows = F.when((F.size("text_edits") == 0) & (F.size("missing_components") == 0) & (F.size("warnings") == 0), none).otherwise(rows)
    return results.select("doc_id", "ord", F.explode(rows).alias("r"), "original", "edited").select("doc_id", "ord", "r.kind_ord", "r.pos", "original", "edited", "r.kind", "r.detail")


LAST = 2147483647


def edit_rows(results: DataFrame) -> DataFrame:
    """The earlier workbook: doc_id, ord, pos, original, edited and detail. A row per text edit, or one without; original and edited stand
    in the first row only, and an empty row ends each reference."""
    texts = F.transform("text_edits", lambda e: F.concat_ws(" to ", e["original_text"], e["edited_text"]))
    shown = F.when(F.size(texts) > 0, texts).otherwise(F.array(F.lit("")))
    row = lambda pos, original, edited, detail: F.struct(pos.cast("int").alias("pos"), original.alias("original"), edited.alias("edited"), detail.alias("detail"))
    first = lambda i, c: F.when(i == 0, F.col(c)).otherwise("")
    rows = let(shown, lambda s: F.concat(F.transform(s, lambda x, i: row(i, first(i, "original"), first(i, "edited"), x)), F.array(row(F.lit(LAST), F.lit(""), F.lit(""), F.lit("")))))
    return results.select("doc_id", "ord", F.explode(rows).alias("r")).select("doc_id", "ord", "r.*")
