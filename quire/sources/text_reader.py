"""Text documents as a table of blocks with exact spans.

Invariant: the blocks of a document joined by line ends are its full text, and block spans count code points in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.lexicon import in_lexicon
from quire.functions.patterns import CAPTION, PAGE_NUMBER
from quire.functions.text import count_of, count_of_chars, count_of_words, is_blank, is_upper, lines, norm_line, rstrip, strip, title_case_ratio
from quire.partitions import CHARS, tasks_of

RUN = "struct<text:string,bold:boolean,italic:boolean,caps:boolean,font_name:string,font_size:double,underline:string,strike:boolean,color:string,highlight:string,vert_align:string>"
MANY_PAGES = REPEATS = 3
EDGE_CHARS, HEADING_CHARS = 120, 70


def format_of(path: Column) -> Column:
    """docx or text by a path's ending, null for what is not supported."""
    low = F.lower(path)
    return F.when(low.endswith(".docx"), "docx").when(low.endswith(".txt") | low.endswith(".text"), "text")


def read_texts(spark, path: str, folders: bool = False) -> DataFrame:
    """Whole files: path, raw. Invalid UTF-8 is replaced. With ``folders`` a task lists and reads a folder of many that are in the path (see
    services.FilesSource): Spark's reader would know all files on the driver, and begin a task for every 32 of them."""
    if folders:
        files = spark.read.format("quire_files").option("suffixes", ".txt,.text").load(path)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(format_of(F.col("path")) == "text").select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("raw"))


def text_lines(docs: DataFrame, doc_id: str = "doc_id", raw: str = "raw") -> DataFrame:
    """doc_id, page, line, text, blank, page_number, key, many_pages: pages are split at form feeds. Null texts are empty."""
    pages = docs.select(F.col(doc_id).alias("doc_id"), F.split(F.coalesce(F.col(raw), F.lit("")), "\f").alias("p"))
    pages = pages.select("doc_id", (F.size("p") >= MANY_PAGES).alias("many_pages"), F.posexplode("p").alias("page", "t"))
    out = pages.select("doc_id", "many_pages", "page", F.posexplode(lines(F.col("t"))).alias("line", "text"))
    return out.select("*", is_blank(F.col("text")).alias("blank"), F.col("text").rlike(PAGE_NUMBER).alias("page_number"), F.when(F.col("many_pages"), norm_line(F.col("text"))).alias("key"))


def _at_edges(numbered: DataFrame) -> DataFrame:
    """Adds times: how often a line stands at the start or end of its page, for short lines of documents with many pages; else 0."""
    shown = F.col("many_pages") & ~F.col("blank")
    page = Window.partitionBy("doc_id", "page", shown).orderBy("line")
    place, n = F.row_number().over(page), F.count(F.lit(1)).over(page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    times = (F.col("__a") <= 2).cast("int") + (F.col("__n") - F.col("__a") < 2).cast("int")
    fits = shown & ~F.col("page_number") & (F.length(strip(F.col("text"))) <= EDGE_CHARS)
    return numbered.select("*", place.alias("__a"), n.alias("__n")).withColumn("times", F.when(fits, times).otherwise(0)).drop("__a", "__n")


def repeated_lines(numbered: DataFrame) -> DataFrame:
    """doc_id, key, n: short lines that stand at the start or end of at least three pages. A line of a page with fewer than four
    lines can be at both ends and counts twice."""
    ends = _at_edges(numbered).filter("times > 0")
    return ends.groupBy("doc_id", "key").agg(F.sum("times").alias("n")).filter((F.col("n") >= REPEATS) & (F.col("key") != ""))


def split_streams(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Body lines (blank ones too), and excluded lines with their stream: page_numbers or headers_footers. Repeated lines are told by a window
    over the document's lines, which needs no exchange where lines are dealt by document."""
    marked = _at_edges(numbered)
    repeats = F.sum("times").over(Window.partitionBy("doc_id", "key"))
    marked = marked.withColumn("repeats", F.when(F.col("key") != "", repeats))
    stream = F.when(F.col("blank"), None).when(F.col("page_number"), "page_numbers").when(F.col("repeats") >= REPEATS, "headers_footers")
    marked = marked.withColumn("stream", stream)
    out = marked.filter("stream is not null").select("doc_id", "stream", "page", "line", strip(F.col("text")).alias("text"))
    return marked.filter("stream is null"), out


def paragraphs(body: DataFrame) -> DataFrame:
    """doc_id, page, island, blanks (blank lines before, in the document), lines: runs of lines without a blank line or page end."""
    doc = Window.partitionBy("doc_id").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    runs = body.select("doc_id", "page", "line", "blank", strip(F.col("text")).alias("text"), F.sum(F.col("blank").cast("int")).over(doc).alias("blanks")).filter("not blank")
    g = runs.groupBy("doc_id", "page", "blanks").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    return g.select("doc_id", "page", "blanks", F.col("l.text").alias("lines"))


def peelable(first: Column) -> Column:
    """Lines that stand for themselves at the head of a paragraph: headings and captions."""
    heading = (F.length(first) <= HEADING_CHARS) & (in_lexicon(F.when(F.length(first) <= HEADING_CHARS, first)) | (is_upper(first) & (count_of(first, r"\p{L}") >= 4)))
    return heading | F.coalesce(first.rlike(CAPTION), F.lit(False))


def blocks_of_paragraphs(paras: DataFrame) -> DataFrame:
    """doc_id, page, blanks, part, text: leading headings and captions are blocks of their own, but never a paragraph's last line."""
    kept = F.transform(F.col("lines"), lambda x: ~peelable(x))
    n = F.size("lines")
    stop = F.array_position(kept, True)
    peeled = F.when(n == 1, 0).otherwise(F.least(F.when(stop > 0, stop - 1).otherwise(n - 1), n - 1)).cast("int")
    rows = paras.select("doc_id", "page", "blanks", "lines", peeled.alias("k"))
    parts = F.concat(F.slice("lines", F.lit(1), F.col("k")), F.array(F.array_join(F.slice("lines", F.col("k") + 1, F.greatest(n - F.col("k"), F.lit(0))), " ")))
    return rows.select("doc_id", "page", "blanks", F.posexplode(parts).alias("part", "text"))


def spans(blocks: DataFrame, order: list[str]) -> DataFrame:
    """Adds idx, start and end: dense numbers from 0 and spans with one character between blocks."""
    doc = Window.partitionBy("doc_id").orderBy(*order)
    before = F.coalesce(F.sum(F.length("text") + 1).over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = blocks.select("*", (F.row_number().over(doc) - 1).alias("idx"), before.cast("int").alias("start"))
    return out.withColumn("end", (F.col("start") + F.length("text")).cast("int"))


def text_tasks(docs: DataFrame, raw: str = "raw") -> int:
    """As many tasks as the texts' characters need; every document counts a little of its own."""
    return tasks_of(docs, F.coalesce(F.length(raw), F.lit(0)) + 64, CHARS)


def read_blocks(docs: DataFrame, doc_id: str = "doc_id", raw: str = "raw", tasks: int | None = None) -> DataFrame:
    """The blocks of text documents (see features()). Documents without a line that is not blank have none.

    All windows and groups share the document as their key, so the texts are dealt by it before they are lines, and nothing is shuffled after
    that. Texts are measured first, unless ``tasks`` says what text_tasks() found: a task gets a bounded number of characters."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(raw).alias("raw"))
    if not docs.isStreaming:
        docs = docs.repartition(tasks or text_tasks(docs), "doc_id")
    body, _ = split_streams(text_lines(docs))
    parts = blocks_of_paragraphs(paragraphs(body)).withColumn("text", rstrip(F.col("text")))
    at = spans(parts, ["page", "blanks", "part"])
    doc = Window.partitionBy("doc_id").orderBy("idx")
    blank_before = F.when(F.col("part") > 0, 0).otherwise(F.col("blanks") - F.coalesce(F.lag("blanks").over(doc), F.lit(0)))
    new_page = F.col("page") > F.coalesce(F.lag("page").over(doc), F.lit(0))
    one = F.struct(F.col("text").alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("caps"), F.lit(None).cast("string").alias("font_name"),
                   F.lit(None).cast("double").alias("font_size"), F.lit(None).cast("string").alias("underline"), F.lit(False).alias("strike"), F.lit(None).cast("string").alias("color"),
                   F.lit(None).cast("string").alias("highlight"), F.lit(None).cast("string").alias("vert_align"))
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    out = at.select(
        "doc_id", "idx", "text", F.array(one).cast(f"array<{RUN}>").alias("runs"), null("string", "style"), null("string", "style_name"), null("int", "outline"), null("string", "jc"),
        blank_before.cast("int").alias("blank_before"), new_page.alias("page_break_before"), F.lit(False).alias("is_table"), F.lit(False).alias("is_list"), "start", "end",
    )
    return features(out)


def features(blocks: DataFrame) -> DataFrame:
    """Adds stripped, n_words, n_letters, caps_ratio (as shown: caps runs are upper case), bold_ratio, italic_ratio, tc_ratio and
    style_heading_level."""
    shown = F.when(F.size("runs") > 0, F.array_join(F.transform("runs", lambda r: F.when(r["caps"], F.upper(r["text"])).otherwise(r["text"])), "")).otherwise(F.col("text"))
    ink = lambda r: F.length(F.regexp_replace(r["text"], r"\s", ""))
    total = F.aggregate("runs", F.lit(0), lambda a, r: a + ink(r))
    share = lambda flag: F.when(total > 0, F.aggregate("runs", F.lit(0), lambda a, r: a + F.when(r[flag], ink(r)).otherwise(0)) / total).otherwise(0.0)
    style = F.replace(F.lower(F.coalesce("style", F.lit(""))), F.lit(" "), F.lit(""))
    level = F.when(style.rlike(r"^heading\d"), F.substring(style, 8, 1).cast("int")).otherwise(F.col("outline") + 1)
    out = blocks.select("*", strip(F.col("text")).alias("stripped"))
    out = out.select("*", shown.alias("__d"), level.alias("style_heading_level"), share("bold").alias("bold_ratio"), share("italic").alias("italic_ratio"))
    out = out.select("*", count_of_words(F.col("stripped")).alias("n_words"), count_of_chars(F.col("__d"), r"\P{L}").alias("n_letters"), count_of_chars(F.col("__d"), r"\P{Lu}").alias("__u"),
                     title_case_ratio(F.col("stripped")).alias("tc_ratio"))
    return out.withColumn("caps_ratio", F.when(F.col("n_letters") > 0, F.col("__u") / F.col("n_letters")).otherwise(0.0)).drop("__d", "__u")
