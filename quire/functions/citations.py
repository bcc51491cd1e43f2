"""Citations: parsing, numbers, identifiers, author names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import WS, let, squeeze, strip

# Fixed values.
YEAR = r"(?:18|19|20|21)\d{2}"
#: It is asked for a word's start only where a DOI can begin: that question is dear, and there are many words.
DOI = r"(?i)(?=[hd1])\b(?:https?://doi\.org/|doi:\s*)?(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"
DOI_PREFIX = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:)"
NUMBERS = rf"\.\s*{YEAR}\s*;\s*\d+[A-Za-z]?(?:\s*\([^)]*\))*(?:\s*:\s*[A-Za-z]{{0,10}}?\d+(?:\s*[-–—]\s*[A-Za-z]{{0,10}}?\d+)?)?\.?\s*\z"
PAGE_INFO = (
    r"(?iU)(?<!\d)((?:(?:18|19|20|21)\d{2}(?:\s+[A-Za-z]{3,9})?(?:\s+\d{1,2})?|\d{1,2}(?:\s+[A-Za-z]{3,9})|[A-Za-z]{3,9}))?\s*;\s*"
    r"(\d+(?:\s+(?:Suppl|Supplement|Spec|Special)\s*\w+)?)?(?:\s*\(\s*([^()]+?)\s*\))?\s*:\s*([A-Za-z]?\d+(?:\s*[-‐-‒–—]\s*[A-Za-z]?\d+)?)?(?!\w)"
)
SEPARATE_NUMBERS = r"^(.*?)\s+(\d{4};\s*\d+(?:\([^)]*\))?:\s*[\w-]+(?:-[\w-]+)?)\.?\z"
NO_NUMBERS = "Bibliographical Numbers missing for Reference"
NUMBERS_TYPE = "struct<year:string,volume:string,issue:string,pages:string,article_number:string>"


def _none(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean(c: Column) -> Column:
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def first_doi(c: Column) -> Column:
    """The first DOI with its prefix, without closing punctuation; null if there is none."""
    return _none(F.rtrim(F.regexp_extract(c, DOI, 0), F.lit(".,;:")))


def normalize_doi(c: Column) -> Column:
    """A DOI without its resolver or scheme; '' for null."""
    return strip(F.regexp_replace(clean(c), DOI_PREFIX, ""))


def doi_key(c: Column) -> Column:
    return F.lower(normalize_doi(c))


def page_info(c: Column) -> Column:
    """year, volume, issue and pages of the first place with ; and : ; null where absent.

    Only texts that have both are searched, from the words before the first ; on: what is before them cannot be part of a match. One
    replacement brings all groups."""
    names = ("year", "volume", "issue", "pages")
    near = F.regexp_replace(c, r"(?U)\A[^;]*[^\w\s;](?=[\w\s]*;)", "")
    groups = F.regexp_replace(near, rf"(?s)\A.*?(?:{PAGE_INFO}).*\z", "\x01$1\x01$2\x01$3\x01$4")
    found = F.when(F.contains(c, F.lit(";")) & F.contains(c, F.lit(":")), groups)
    return let(F.split(found, "\x01"), lambda g: F.struct(*[F.when(F.size(g) == 5, _none(strip(F.get(g, F.lit(i))))).alias(n) for i, n in enumerate(names, 1)]))


def separate_numbers(c: Column) -> Column:
    return F.coalesce(_none(F.regexp_extract(c, SEPARATE_NUMBERS, 2)), F.lit(NO_NUMBERS))


def parse_numbers(c: Column) -> Column:
    """The parts of a citation's numbers as NUMBERS_TYPE; '' where absent. Groups in parentheses join with a blank."""
    group = r"(?:\((?:[^()]|\([^()]*\))*\))"
    names = ("year", "volume", "issue", "pages", "article_number")
    result = lambda *v: F.struct(*[(F.lit(x) if isinstance(x, str) else x).alias(n) for x, n in zip(v, names)])

    def located(x: Column) -> Column:
        """x: year, volume, issue and where."""
        where = x["where"]
        pages = F.when(where.rlike(r"^[A-Za-z]?\d+\s*-\s*[A-Za-z]?\d+\z"), F.regexp_replace(where, r"\s*-\s*", "-")).when(where.rlike(r"^\d+\z"), where).otherwise("")
        return let(pages, lambda p: result(x["year"], x["volume"], x["issue"], p, F.when(p == "", where).otherwise("")))

    def grouped(x: Column) -> Column:
        """x: year, volume and after."""
        groups = F.regexp_extract(x["after"], rf"^((?:{group}\s*)*)", 1)
        parts = F.transform(F.regexp_extract_all(groups, F.lit(group), F.lit(0)), lambda g: strip(F.substr(g, F.lit(2), F.length(g) - 2)))
        where = F.regexp_replace(F.substr(x["after"], F.length(groups) + 1), r"^[ :;,.]+|[ .;,]+\z", "")
        return let(F.struct(x["year"].alias("year"), x["volume"].alias("volume"), F.array_join(F.filter(parts, lambda p: p != ""), " ").alias("issue"), where.alias("where")), located)

    def dated(text: Column) -> Column:
        rest = F.regexp_replace(F.regexp_extract(text, rf"\b{YEAR}\b(.*)\z", 1), r"^[ ;,.]+", "")
        year = F.regexp_extract(text, rf"\b({YEAR})\b", 1)
        parts = let(F.struct(year.alias("year"), rest.alias("rest")), lambda x: F.struct(x["year"].alias("year"), F.regexp_extract(x["rest"], r"^(\d+[A-Za-z]*)", 1).alias("volume"), F.regexp_extract(x["rest"], r"^\d+[A-Za-z]*\s*(.*)\z", 1).alias("after")))
        return let(parts, lambda x: F.when((x["year"] == "") | (x["volume"] == ""), result(x["year"], "", "", "", "")).otherwise(grouped(x)))

    text = F.regexp_replace(F.regexp_replace(squeeze(F.coalesce(c, F.lit(""))), "[‐-‒–—−]", "-"), r"^[ .;:]+|[ .;:]+\z", "")
    return let(text, dated)


def parse_reference(c: Column, compat: bool = True) -> Column:
    """author, title, numbers, doi and actual_ref of a citation; '' where absent.

    With compat a citation that ends in numbers has everything before the DOI in ``numbers``; without, numbers start after the
    last sentence before the journal."""
    et_al = r"(?i)^(.+?(?=et al)\bet al\.?)\s+(.+)\z"

    def cut(text: Column) -> Column:
        """The DOI, and the text before it. What may stand before a DOI has no 10. in it."""
        return let(F.regexp_extract(text, DOI, 0), lambda found: F.struct(
            F.rtrim(F.substr(found, F.instr(found, "10.")), F.lit(".,;)]}")).alias("doi"),
            F.when(found != "", F.rtrim(F.substr(text, F.lit(1), F.instr(text, found) - 1), F.lit(" .,;"))).otherwise(text).alias("text")))

    def numbered(x: Column) -> Column:
        text = x["text"]
        if compat:
            numbers = F.when(F.substr(text, F.lit(2)).rlike(rf"(?i){NUMBERS}"), strip(text)).otherwise("")
            rest = lambda n: F.when(n != "", "").otherwise(text)
        else:
            split = rf"(?i)^(?:.*[.?!]\s+)?([^.]+{NUMBERS})"
            numbers = strip(F.regexp_extract(text, split, 1))
            rest = lambda n: F.when(n != "", strip(F.substr(text, F.lit(1), F.length(text) - F.length(n)))).otherwise(text)
        return let(numbers, lambda n: F.struct(x["doi"].alias("doi"), n.alias("numbers"), rest(n).alias("rest")))

    def divided(x: Column) -> Column:
        """At et al., or else at the first full stop, if a blank follows. There are no two blanks in a row, nor one at the end."""
        rest = x["rest"]
        made = lambda author, title: F.struct(strip(author).alias("author"), strip(title).alias("title"), x["numbers"].alias("numbers"), x["doi"].alias("doi"))
        first = lambda a: F.when((a != "") & F.startswith(F.substr(rest, F.length(a) + 1), F.lit(". ")), made(a, F.substr(rest, F.length(a) + 2))).otherwise(made(F.lit(""), rest))
        return F.when(rest == "", made(rest, rest)).when(rest.rlike(et_al), made(F.regexp_extract(rest, et_al, 1), F.regexp_extract(rest, et_al, 2))).otherwise(let(F.substring_index(rest, ".", 1), first))

    raw = F.coalesce(c, F.lit(""))
    dashes = "‐‒–—−"
    # most texts are ASCII without blanks in a row, in which there is neither white space nor a dash to change
    plain = F.when(raw.rlike("[^ -~]|  "), F.regexp_replace(F.regexp_replace(raw, f"[{WS}]+", " "), f"[{dashes}]", "-")).otherwise(raw)
    text = F.regexp_replace(strip(plain), r"^\s*(?:\[\d+\]|\(\d+\)|\d+[.)])\s*", "")
    out = let(let(let(text, cut), numbered), divided)
    return let(out, lambda x: F.struct(x["author"].alias("author"), x["title"].alias("title"), x["numbers"].alias("numbers"), x["doi"].alias("doi"), c.alias("actual_ref")))


def format_numbers(numbers: Column, compat: bool = True) -> Column:
    """year;volume(issue):pages, with the article number where there are no pages; null without year or volume. compat keeps a year
    without four digits as the text None."""
    part = lambda n: clean(numbers[n])
    year, volume, issue = part("year"), part("volume"), part("issue")
    long_year = F.regexp_extract(year, rf"\b{YEAR}\b", 0)
    long_year = F.when(long_year == "", F.lit("None")).otherwise(long_year) if compat else _none(long_year)
    shown = F.when(F.length(year) > 4, long_year).otherwise(year)
    where = F.coalesce(_none(part("pages")), part("article_number"))
    text = F.concat(shown, F.lit(";"), volume, F.when(issue != "", F.concat(F.lit("("), issue, F.lit(")"))).otherwise(""), F.when(where != "", F.concat(F.lit(":"), where)).otherwise(""))
    return F.when((year != "") & (volume != ""), text)


def _starts_lower(c: Column) -> Column:
    return F.regexp_extract(c, r"^\P{L}*(\p{L})", 1).rlike(r"^\p{Ll}")


def _initials(parts: Column, separator: str) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.when(_starts_lower(p), p).otherwise(F.upper(F.substring(p, 1, 1)))), separator)


def format_author(author: Column) -> Column:
    """Surname and initials. Lower-case particles right before the last name belong to it; others stay among the initials."""
    words = lambda c: F.filter(F.split(c, f"[{WS}]+"), lambda p: p != "")

    def plain(x: Column) -> Column:
        """x: parts, n and run (the length of the run of lower-case parts at the end of those before the last)."""
        parts, n, run = x["parts"], x["n"], x["run"]
        return strip(F.concat_ws(" ", F.array_join(F.slice(parts, n - run, run + 1), " "), _initials(F.slice(parts, F.lit(1), F.greatest(n - 1 - run, F.lit(0))), "")))

    def of(parts: Column) -> Column:
        n = F.size(parts)
        run = F.aggregate(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), F.lit(0), lambda a, p: F.when(_starts_lower(p), a + 1).otherwise(0))
        return F.when(n == 0, "").when(author.contains(","), comma).otherwise(let(F.struct(parts.alias("parts"), n.alias("n"), run.alias("run")), plain))

    given = strip(F.substr(author, F.instr(author, ",") + 1))
    comma = strip(F.concat_ws(" ", strip(F.substring_index(author, ",", 1)), _initials(words(given), " ")))
    return let(words(author), of)


def format_authors(authors: Column) -> Column:
    """All names and a full stop, or the first three and et al. of more than six; '' for none."""
    names = F.filter(F.transform(authors, lambda a: F.regexp_replace(squeeze(a), "[‐-‒–—]", "-")), lambda a: a.isNotNull() & (a != ""))
    shown = lambda some: F.array_join(F.transform(some, format_author), ", ")
    text = let(names, lambda a: F.when(F.size(a) > 6, F.concat(shown(F.slice(a, 1, 3)), F.lit(", et al."))).otherwise(F.concat(shown(a), F.lit("."))))
    return F.when(F.coalesce(F.size(authors), F.lit(0)) <= 0, "").otherwise(text)


def split_change(c: Column) -> Column:
    """old and new of 'old to new' at the first blank-bounded to; nulls without one."""
    parts = F.split(strip(c), r"(?i)\s+to\s+", 2)
    found = F.size(parts) == 2
    return F.struct(F.when(found, strip(F.get(parts, F.lit(0)))).alias("old_text"), F.when(found, strip(F.get(parts, F.lit(1)))).alias("new_text"))


def merge_spans(spans: Column) -> Column:
    """Sorted spans (start, end) with overlapping ones merged; spans that only touch stay apart."""
    first = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(last.isNotNull() & (s["start"] < last["end"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans.cast("array<struct<start:int,end:int>>")), first, step)
