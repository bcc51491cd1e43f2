"""Text functions as column expressions.

White space is what Python's str.strip() and str.split() remove: Java's Unicode class and the four separators \\x1c-\\x1f.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: As a class this is one table and one category (Z): each part of a class is tried for each character.
WS = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\p{Z}"
#: The same as characters.
WS_CHARS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

#: Spaces and zero-width characters that count as a blank.
ODD_SPACES = "\u00a0\u200b\u200c\u200d\ufeff\u2007\u202f"
STOP_WORDS = "a an and the of in on for to with by at or vs via from as its".split()


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c computed once however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def leading(a: Column, fits: Callable[[Column, Column], Column]) -> Column:
    """The first elements of an array, up to one that does not fit; fits gets an element and its number."""
    stop = F.array_position(F.transform(a, fits), False)
    return F.when(stop == 0, a).otherwise(F.slice(a, F.lit(1), (stop - 1).cast("int")))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def squeeze(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return strip(F.regexp_replace(c, f"[{WS}]+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"[{WS}]+"), lambda w: w != "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(f"[^{WS}]")


def lines(c: Column) -> Column:
    """The lines of a text; a final line break starts no line."""
    parts = F.split(c, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def clean_spaces(c: Column) -> Column:
    return F.translate(c, ODD_SPACES, " " * len(ODD_SPACES))


@cache
def _compatible() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility form is ASCII: one to one, and ligatures."""
    one, to, many = [], [], {}
    for i in range(0x80, 0x110000):
        ch = chr(i)
        n = unicodedata.normalize("NFKC", ch)
        if n != ch and n.isascii():
            if len(n) == 1:
                one.append(ch)
                to.append(n)
            elif n.isalpha() or n in ("...", "..", "!!", "??"):
                many[ch] = n
    return "".join(one), "".join(to), {k: v for k, v in many.items() if ord(k) < 0x3000 or 0xFB00 <= ord(k) <= 0xFB06}


def compatible(c: Column) -> Column:
    """NFKC as far as the result is ASCII. Only texts with such characters pay for it."""
    one, to, many = _compatible()
    out = F.translate(c, one, to)
    for k, v in many.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.when(c.rlike(r"[^\x00-\x7f]"), out).otherwise(c)


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def is_upper(c: Column) -> Column:
    """At least one cased letter, and none in lower or title case."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Ll}\p{Lt}]")


#: The start of a word that is no stop word.
_CONTENT = rf"(?<![^{WS}])(?!(?i:{'|'.join(STOP_WORDS)})(?![^{WS}]))"


def title_case_ratio(c: Column) -> Column:
    """Share of content words (with a letter, no stop words) that start in upper case; 0 without content words. Two searches of the text: a
    test of each word costs many times as much."""
    content, upper = count_of(c, rf"{_CONTENT}[^\p{{L}}{WS}]*+\p{{L}}[^{WS}]*+"), count_of(c, rf"{_CONTENT}\p{{Lu}}")
    return F.when(content > 0, upper / content).otherwise(0.0)


def count_of_chars(c: Column, others: str) -> Column:
    """How many characters are left without those of the class ``others``; matches one by one cost an array."""
    return F.length(F.regexp_replace(c, f"{others}+", ""))


def count_of_words(c: Column) -> Column:
    """As many as words() has."""
    return count_of(c, f"[^{WS}]++")


def norm_line(c: Column) -> Column:
    """Lower case, digit runs as #, white space squeezed."""
    return squeeze(F.regexp_replace(F.lower(c), r"\d+", "#"))


def norm_for_similarity(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(c), r"[-–—•\t]", " "))


def ends_like_sentence(c: Column) -> Column:
    """True after , ; ? ! and after a full stop that ends no dotted abbreviation."""
    s = rstrip(c)
    return F.coalesce(s.rlike(r"[,;?!]\z") | (s.endswith(".") & ~s.rlike(r"(?:\b[A-Za-z]\.){2,}\z")), F.lit(False))


def normalize_name(c: Column) -> Column:
    return F.upper(squeeze(F.coalesce(c.cast("string"), F.lit(""))))


def normalize_font_name(c: Column) -> Column:
    return F.lower(squeeze(F.coalesce(c.cast("string"), F.lit(""))))


def is_all_caps(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\p{L}") & ~c.rlike(r"[\p{Ll}\p{Lt}\p{Lo}\p{Lm}]"), F.lit(False))


def _latin_words(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))


def is_headline_case(c: Column) -> Column:
    w = _latin_words(c)
    return (F.size(w) > 0) & F.forall(w, lambda x: x.rlike("^[A-Z]"))


def is_sentence_case(c: Column) -> Column:
    w = _latin_words(c)
    first = F.coalesce(F.get(w, F.lit(0)).rlike("^[A-Z]"), F.lit(False))
    return first & F.forall(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda x: ~x.rlike("^[A-Z]"))


def sentence_case(c: Column) -> Column:
    """Lower case, but for ASCII letters at the start and after . ! ? and white space."""
    sentences = F.split(F.lower(c), rf"(?<=[.!?])(?=[{WS}]+[a-z])")
    first = lambda p, i: F.when(i == 0, F.regexp_extract(p, r"\A[a-z]", 0)).otherwise(F.regexp_extract(p, rf"\A[{WS}]+[a-z]", 0))
    return F.array_join(F.transform(sentences, lambda p, i: let(first(p, i), lambda x: F.concat(F.upper(x), F.substr(p, F.length(x) + 1)))), "")


#: Characters after which sheet names are cut and the pattern of entities that journal names have.
SHEET_FORBIDDEN = r"[\\/*?:\[\]]"
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " "}


def unescape_entities(c: Column) -> Column:
    out = c
    for k, v in ENTITIES.items():
        if k != "&amp;":
            out = F.replace(out, F.lit(k), F.lit(v))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def normalize_journal_name(c: Column) -> Column:
    return F.replace(F.lower(strip(unescape_entities(F.coalesce(c, F.lit(""))))), F.lit("."), F.lit(""))


def sheet_name(c: Column) -> Column:
    """A file name's stem as a sheet name: at most 31 characters, none that sheets forbid."""
    stem = F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"(?<=.)\.[^.]*\z", "")
    clean = F.regexp_replace(stem, SHEET_FORBIDDEN, "_")
    return F.substring(F.when(clean == "", "Validation").otherwise(clean), 1, 31)


def list_to_string(c: Column, separator: str = " | ") -> Column:
    return F.coalesce(F.array_join(c.cast("array<string>"), separator), F.lit(""))
