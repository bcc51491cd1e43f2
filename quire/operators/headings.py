"""Roles of blocks, and candidates for headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import patterns as rx
from quire.functions.lexicon import BACK, RUN_IN, SUBSECTIONS, TYPE_OF, add_match, glued_prefix, normalize
from quire.functions.text import WS, count_of, ends_like_sentence, let, rstrip, strip, words

#: Roles that are never headings.
NO_HEADING = ("table", "empty", "caption", "metadata_count", "contact", "orcid_line", "byline", "abbrev_line", "credit_line")
CANDIDATE = "struct<kind:string,section_type:string,name:string,level:int,strength:int,prefix_len:int,conf:double,signals:array<string>>"


def _has(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def _before_colon(s: Column) -> Column:
    return F.substring_index(s, ":", 1)


def _after_colon(s: Column) -> Column:
    return F.substr(s, F.instr(s, ":") + 1)


def add_roles(blocks: DataFrame) -> DataFrame:
    """Adds lex (the vocabulary's match of the whole block) and role: the first rule that fits, null for ordinary text."""
    df = add_match(blocks, F.col("stripped"), "lex")
    s, n = F.col("stripped"), F.length("stripped")
    email, street, institution = _has(s, rx.EMAIL), _has(s, rx.STREET), _has(s, rx.INSTITUTION)
    tags = _has(s, rx.COPYEDIT_TAG)
    degrees = F.regexp_extract_all(s, F.lit(rx.DEGREES), F.lit(1))
    sure = lambda d: F.size(F.filter(d, lambda x: ~x.isin(rx.AMBIGUOUS_DEGREES))) > 0
    degree = let(degrees, lambda d: sure(d) | (F.size(d) >= 2) | ((F.size(d) == 1) & _has(s, r",\d")))
    tokens = words(s)
    capital = F.size(F.filter(tokens, lambda w: w.rlike(r"^[\p{Lu}\p{Nd}]")))
    colon = F.instr(s, ":")
    role = (
        F.when(F.col("is_table"), "table")
        .when(s == "", "empty")
        .when(_has(s, rx.CAPTION), "caption")
        .when(_has(s, rx.METADATA_COUNT), "metadata_count")
        .when(F.col("lex").isNotNull(), None)
        .when(_has(s, rx.ORCID) & (F.col("n_words") <= 10), "orcid_line")
        .when(_has(s, rx.CONTACT) & (n <= 120), "contact")
        .when(_has(s, rx.CORRESPONDENCE), "correspondence")
        .when((n <= 250) & email & (street | _has(s, rx.USA)), "affiliation")
        .when(email & (n <= 80) & (F.col("n_words") <= 10), "contact")
        .when((_has(s, rx.AFFILIATION_START) & (n <= 700)) | tags, "affiliation")
        .when(_has(s, rx.ENUMERATED) & institution & (n <= 400), "affiliation")
        .when((n <= 250) & (institution | email) & (street | _has(s, rx.PRESENT_ADDRESS)), "affiliation")
        .when((n <= 160) & _has(s, r"^\p{Lu}") & (count_of(s, rx.INSTITUTION) >= 2), "affiliation")
        .when(s.contains(",") & (F.col("n_words") >= 4) & (n <= 500) & ~s.endswith(":") & degree & (capital >= 0.6 * F.size(tokens)), "byline")
        .when(_has(s, rx.CREDIT_ROLE) & colon.between(1, 60) & (F.size(words(_before_colon(s))) <= 6), "credit_line")
        .when(_has(s, rx.ABBREVIATION_LINE) & (n <= 90) & colon.between(1, 18) & ~normalize(_before_colon(F.when(n <= 90, s)))["norm"].isin(list(TYPE_OF)), "abbrev_line")
    )
    return df.withColumn("role", role)


def signals() -> Column:
    """What a block's form says, in order."""
    return F.array_compact(F.array(
        F.when(F.coalesce(F.col("style_heading_level"), F.lit(0)) > 0, F.format_string("style:%s(H%d)", F.coalesce("style", F.lit("outline")), "style_heading_level")),
        F.when((F.col("bold_ratio") >= 0.6) & (F.col("n_words") <= 16), F.format_string("bold(%.2f)", "bold_ratio")),
        F.when((F.col("caps_ratio") >= 0.85) & (F.col("n_letters") >= 4), F.format_string("allcaps(%.2f)", "caps_ratio")),
        F.when(F.col("jc") == "center", F.lit("centered")),
        F.when((F.col("n_words") <= 6) & (F.length("stripped") <= 60), F.lit("short-standalone")),
        F.when(F.col("blank_before") >= 1, F.lit("blank-before")),
    ))


def bold_prefix(runs: Column) -> Column:
    """Characters of the leading runs that are bold or blank."""
    step = lambda a, r: F.when(a["on"] & (r["bold"] | ~r["text"].rlike(f"[^{WS}]")), F.struct((a["n"] + F.length(r["text"])).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(a["n"].alias("n"), F.lit(False).alias("on")))
    return F.aggregate(runs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), step)["n"]


def add_candidates(df: DataFrame, text_mode: bool) -> DataFrame:
    """Adds cand (CANDIDATE, or null). Branches are tried in order; each has its own evidence, level and confidence."""
    s, n = F.col("stripped"), F.length("stripped")
    colon = F.instr(s, ":")
    bare = F.regexp_replace(s, rf"[{WS}]*\([^)]{{0,40}}\)[{WS}]*\z", "")
    df = add_match(df, F.when(F.col("lex").isNull() & s.contains("(") & (bare != s), bare), "lex_bare")
    df = add_match(df, F.when(colon.between(1, 70), _before_colon(s)), "lex_prefix")
    df = df.withColumn("bold_len", F.lit(0) if text_mode else bold_prefix(F.col("runs")))
    if not text_mode:
        bold = (F.col("bold_len").between(3, 80)) & (n - F.col("bold_len") >= 25)
        df = add_match(df, F.when(bold, strip(F.substr("text", F.lit(1), F.col("bold_len")))), "lex_bold")
    sig = F.concat(signals(), F.when(F.col("lex_bare").isNotNull(), F.array(F.lit("trailing-parenthetical-stripped"))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("sig", sig).withColumn("lex_any", F.coalesce("lex", "lex_bare"))
    lex, prefix = F.col("lex_any"), F.col("lex_prefix")
    shown = lambda t: F.when(t == "_summary_ambiguous", "summary").otherwise(t)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    of_lex = lambda m: text("lexicon:'", m["variant"], "'")

    def cand(kind, type_, name, level, strength, conf, extra, prefix_len=F.lit(0)):
        values = (F.lit(kind), type_, name, level, strength, prefix_len, conf, extra)
        names = ("kind", "section_type", "name", "level", "strength", "prefix_len", "conf", "signals")
        return F.struct(*[(F.lit(v) if isinstance(v, (int, float)) else v).alias(k) for k, v in zip(names, values)]).cast(CANDIDATE)

    tail = F.length(strip(_after_colon(s)))
    caps = (F.col("caps_ratio") >= 0.85) & (F.col("n_letters") >= 4)
    styled = F.coalesce(F.col("style_heading_level"), F.lit(0)) > 0
    first_level = F.coalesce(F.col("style_heading_level") == 1, F.lit(False))

    formed = F.exists("sig", lambda x: x.startswith("style:") | x.startswith("bold") | x.startswith("allcaps") | x.startswith("centered"))
    weak = F.lit(text_mode) | F.array_contains("sig", "short-standalone") | (lex["numbering"] != "")
    other = F.coalesce(F.col("role") == "correspondence", F.lit(False)) & (lex["type"] != "correspondence")
    strength = F.when(caps, 3).when((F.col("bold_ratio") >= 0.6) | styled, 2).otherwise(1)
    whole = lex.isNotNull() & (n <= 120) & (F.col("n_words") <= 16) & ~other & (formed | weak)
    whole_level = F.when(lex["type"].isin(list(SUBSECTIONS)), 2).when(caps | first_level, 1).otherwise(2)
    noted = F.array_compact(F.array(of_lex(lex), F.when(lex["numbering"] != "", text("numbering:'", lex["numbering"], "'")), F.when(lex["had_colon"], F.lit("trailing-colon"))))

    content = prefix.isNotNull() & ~F.col("is_table") & prefix["type"].isin("keywords", "running_head", "orcid", "word_count_marker") & tail.between(1, 300)
    label = prefix.isNotNull() & (n <= 110) & ~F.col("is_table") & prefix["type"].isin(sorted(RUN_IN | BACK | {"title_page_marker"})) & tail.between(1, 40)
    named = text(_before_colon(s), ":")
    label_conf = F.when((F.col("bold_ratio") >= 0.3) | (F.col("caps_ratio") >= 0.5) | styled, 0.85).otherwise(0.7)
    branches = [
        (whole, cand("standalone", shown(lex["type"]), s, whole_level, strength, F.when(formed, 0.9).otherwise(0.75), F.concat("sig", noted))),
        (content, cand("runin", prefix["type"], named, 1, 1, 0.85, F.concat("sig", F.array(text("content-label:'", named, "'"), of_lex(prefix))), colon)),
        (label, cand("standalone", shown(prefix["type"]), named, 2, 1, label_conf, F.concat("sig", F.array(text("label-with-short-tail:'", F.substring(s, 1, 60), "'"), of_lex(prefix))))),
    ]
    if text_mode:
        run = prefix.isNotNull() & (colon <= 60) & (tail >= 25) & prefix["type"].isin(sorted(RUN_IN))
        branches.append((run, cand("runin", shown(prefix["type"]), named, 3, 1, 0.7, F.array(text("colon-run-in-label:'", named, "'"), of_lex(prefix)), colon)))
    else:
        bold = F.col("lex_bold")
        run = bold.isNotNull() & bold["type"].isin(sorted(RUN_IN))
        name = strip(F.substr("text", F.lit(1), F.col("bold_len")))
        branches.append((run, cand("runin", shown(bold["type"]), name, 3, 1, 0.85, F.array(text("bold-run-in-label:'", name, "'"), of_lex(bold)), F.col("bold_len"))))
        glue = glued_prefix(F.when((F.col("bold_ratio") >= 0.5) & (n <= 120), s))
        df = df.withColumn("glue", glue)
        types = F.create_map(*[F.lit(x) for v, t in TYPE_OF.items() if t in RUN_IN | BACK for x in (v, t)])
        part = F.substr(s, F.lit(1), F.length("glue"))
        branches.append((F.col("glue").isNotNull(), cand("glued", F.try_element_at(types, F.col("glue")), part, 2, 1, 0.55, F.array(text("glued-label:'", part, "'")), F.length("glue"))))
    strong = (
        F.col("style_heading_level").isNotNull()
        | ((F.col("bold_ratio") >= 0.6) & ((F.col("caps_ratio") >= 0.85) | (F.col("tc_ratio") >= 0.8)))
        | ((F.col("caps_ratio") >= 0.85) & (F.col("n_letters") >= 6))
    )
    no_end = ~ends_like_sentence(s) & ~rstrip(s).endswith(":")
    form = (
        ~F.coalesce(F.col("role").isin("correspondence", "affiliation"), F.lit(False)) & (n <= 90) & (F.col("n_words") <= 12) & (F.col("n_letters") >= 3) & no_end & strong & ~F.col("is_list")
    )
    capital = F.col("caps_ratio") >= 0.85
    plain = F.array_compact(F.array(F.lit("no-lexicon-match: structural evidence only"), F.when(rstrip(s).endswith("."), F.lit("terminal '.' accepted: dotted abbreviation"))))
    branches.append((form, cand("standalone", F.lit(None).cast("string"), s, F.when(capital | first_level, 1).otherwise(2), F.when(capital, 3).otherwise(2), 0.65, F.concat("sig", plain))))
    open_ = ~F.coalesce(F.col("role").isin(*NO_HEADING), F.lit(False)) & (s != "")
    out = F.lit(None).cast(CANDIDATE)
    for when, value in reversed(branches):
        out = F.when(F.coalesce(when, F.lit(False)), value).otherwise(out)
    return df.withColumn("cand", F.when(open_, out)).drop("lex_bare", "lex_any", "lex_prefix", "lex_bold", "bold_len", "sig", "glue")


def add_reference_shape(df: DataFrame) -> DataFrame:
    """Adds is_ref: the block looks like an entry of a bibliography."""
    s, n = F.col("stripped"), F.length("stripped")
    style = F.lower(F.coalesce("style", F.lit("")))
    year, link = _has(s, rx.YEAR), _has(s, rx.DOI_OR_URL)
    numbered = (_has(s, rx.REFERENCE_ENTRY) | _has(s, rx.BARE_REFERENCE)) & (year | link | (n > 80))
    return df.withColumn("is_ref", style.contains("reference") | style.contains("bibliograph") | numbered | (link & (n <= 200) & ~F.col("is_table")))


def screened(blocks: DataFrame, text_mode: bool = True) -> DataFrame:
    return add_reference_shape(add_candidates(add_roles(blocks), text_mode))
