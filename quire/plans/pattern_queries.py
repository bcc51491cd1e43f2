"""One query per pattern: lines that are made from parts, and whether or how the pattern fits them.

Each case is a line in SQL (n is a number of the part, so that lines differ) and what is expected of it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import citations as ct
from quire.functions import lexicon as lx
from quire.functions import patterns as rx
from quire.functions import text as tx
from quire.functions import titles as tt
from quire.operators import headings, marks
from quire.plans.registry import derived
from quire.sources.text_reader import read_blocks


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if str(v).startswith("'") or not isinstance(v, str) else "'" + v.replace("'", "''") + "'"


def cases(name: str, rows: list[tuple[str, object]], result: str, kind: str, of) -> None:
    """Registers a query with a row per part: k and result = of(column of lines)."""
    pick = lambda i: "CASE p_partkey % " + str(len(rows)) + " " + " ".join(f"WHEN {k} THEN {_literal(r[i]) if i else r[0]}" for k, r in enumerate(rows) if i == 0 or r[1] is not None) + " END"
    sql = f"SELECT p_partkey AS k, p_size AS n, {pick(0)} AS s FROM {{part}}"
    expected = pick(1).replace("p_partkey", "k")
    derived(name, sql, f"SELECT k, ({expected})::{kind} AS {result} FROM i")(lambda i: i.select("k", of(F.col("s")).alias(result)))


def fits(pattern: str):
    return lambda c: F.coalesce(c.rlike(pattern), F.lit(False))


def group(pattern: str, k: int):
    """A group of a pattern, null where the pattern does not fit."""
    return lambda c: F.when(c.rlike(pattern), F.regexp_extract(c, pattern, k))


cases("rx_01_caption", [("'Table ' || (p_size % 90 + 1) || '. Of parts'", True), ("'Figure ' || (p_size % 90 + 1) || ': parts'", True), ("'Supplementary Table ' || (p_size % 9 + 1) || '.'", True), ("'Fig. IV. parts'", True), ("'Appendix Figure A. parts'", True),
                        ("'Tables ' || p_size || '. Of parts'", False), ("'Table ' || p_size || ' of parts'", False), ("'Table 1234. Of parts'", False), ("'See Table 1. Of parts'", False), ("'  online box 2 . ' || p_size", True)], "hit", "BOOLEAN", fits(rx.CAPTION))
cases("rx_02_metadata_count", [("'Word count: ' || p_size", True), ("'Tables/Figures: ' || p_size", True), ("'manuscript word count – 3,' || (p_size + 100) || ' words'", True), ("'Number of tables ' || p_size", True), ("'References ' || p_size || ' (at most 50)'", True),
                               ("'Word count'", False), ("'Words: ' || p_size", False), ("'Word count: ' || p_size || ' and more'", False)], "hit", "BOOLEAN", fits(rx.METADATA_COUNT))
cases("rx_03_contact", [("'Phone: ' || p_size", True), ("'FAX ' || p_size", True), ("'E-mail address of authors ' || p_size", True), ("' tel. ' || p_size", True), ("'email'", True), ("'Telephones ' || p_size", False), ("'My phone ' || p_size", False)], "hit", "BOOLEAN", fits(rx.CONTACT))
cases("rx_04_email", [("'write to a' || p_size || '@b.org now'", True), ("'a@b' || p_size", False), ("'@b.org'", False), ("'a @ b.org'", False), ("'x@y.z'", True)], "hit", "BOOLEAN", fits(rx.EMAIL))
cases("rx_05_orcid", [("'0000-0002-1825-00' || (p_size % 10) || 'X'", True), ("'id 0000-0002-1825-009' || (p_size % 10) || '.'", True), ("'0000-0002-1825-00' || (p_size % 10)", False), ("'00000-0002-1825-0097'", False), ("'0000-0002-1825-0097' || '1'", False)], "hit", "BOOLEAN", fits(rx.ORCID))
cases("rx_06_degrees", [("'Jane ' || p_size || ', MD, PhD'", "MD|PhD"), ("'Roe, MPH1'", "MPH"), ("'Poe MAster'", ""), ("'A. FACP, PA-C, RN'", "FACP|PA-C|RN"), ("'md phd'", ""), ("'MA of size ' || p_size", "MA")], "found", "VARCHAR",
      lambda c: F.array_join(F.regexp_extract_all(c, F.lit(rx.DEGREES), F.lit(1)), "|"))
cases("rx_07_affiliation_start", [("'From the Department ' || p_size", True), ("'<organization>Uni'", True), ("'1 University'", True), ("'12Uni'", True), ("'from <organization>'", True), ("'From there'", False), ("'123 University'", False), ("'Department ' || p_size", False)], "hit", "BOOLEAN", fits(rx.AFFILIATION_START))
cases("rx_08_institutions", [("'University Hospital of ' || p_size", 2), ("'the school of life'", 1), ("'Acme Inc. and Beta LLC'", 2), ("'Schools and universities'", 0), ("'National Center, Foundation'", 2), ("'part ' || p_size", 0)], "n", "INT", lambda c: tx.count_of(c, rx.INSTITUTION))
cases("rx_09_correspondence", [("'Address correspondence to ' || p_size", True), ("'* Corresponding author'", True), ("'Correspondence: x'", True), ("'†Address reprint requests'", True), ("'correspondences'", False), ("'Our correspondence'", False)], "hit", "BOOLEAN", fits(rx.CORRESPONDENCE))
cases("rx_10_copyedit_tag", [("'<organization>' || p_size", True), ("'in <City>, <zip>'", True), ("'<organisation>'", False), ("'< city>'", False), ("'state'", False)], "hit", "BOOLEAN", fits(rx.COPYEDIT_TAG))
cases("rx_11_reference_shape", [("'[12] Doe J.'", "entry"), ("'3. Doe J. ' || '2019'", "entry|year"), ("'4) see https://x.org/' || p_size", "entry|link"), ("'Doe 1899'", ""), ("'in 2019 by www.x.org'", "year|link"), ("'1234. Doe'", ""), ("'DOI 10.1/x'", "link"), ("'5.'", "")], "shape", "VARCHAR",
      lambda c: F.concat_ws("|", F.when(c.rlike(rx.REFERENCE_ENTRY), "entry"), F.when(c.rlike(rx.YEAR), "year"), F.when(c.rlike(rx.DOI_OR_URL), "link")))
cases("rx_12_dotted_end", [("'made in the U.S.'", False), ("'as shown, e.g.'", False), ("'size ' || p_size || '.'", True), ("'Mr. A.'", True), ("'the U.S.A.'", False), ("'the US.'", True)], "sentence", "BOOLEAN", tx.ends_like_sentence)
cases("rx_13_abbreviation_line", [("'BMI: body mass index ' || p_size", True), ("'IL-6, interleukin'", True), ("'a/b(c)+: x'", True), ("'BMI body: mass'", False), ("'1BMI: body'", False), ("'ABCDEFGHIJKLMNOPQ: too long'", False), ("'BMI:x'", False)], "hit", "BOOLEAN", fits(rx.ABBREVIATION_LINE))
cases("rx_14_credit_role", [("'Jane Doe: Writing, Software ' || p_size", True), ("'Roe: Data Curation'", True), ("'Roe: data curation'", False), ("'Software by Roe'", False), ("'x: Formal analysis.'", True), ("'x: Softwares'", False)], "hit", "BOOLEAN", fits(rx.CREDIT_ROLE))
cases("rx_15_normalisation", [("'**Methods:**'", "methods"), ("'# 1.2. Methods;'", "1.2~methods"), ("'IV) Results –'", "IV~results"), ("'B. Tables & Co'", "B~tables and co"), ("'(c) “Quoted” - text'", "c~quoted-text"), ("'2 . x'", "2~. x"), ("'Plain   words'", "plain words")], "shown", "VARCHAR",
      lambda c: tx.let(lx.normalize(c), lambda n: F.concat_ws("~", F.nullif(n["numbering"], F.lit("")), n["norm"])))
cases("rx_16_addresses", [("'12 Main Street, Town'", "street"), ("p_size + 10 || ' Great North Rd.'", "street"), ("'Madison, WI, USA'", "usa"), ("'Town, U.S.A.'", "usa"), ("'a. University'", "listed"), ("'12) Hospital'", "listed"), ("'3. Present address: Town'", "listed|present"), ("'4 Present address'", "present"), ("'1 Main Street'", ""), ("'no address ' || p_size", "")],
      "kinds", "VARCHAR", lambda c: F.concat_ws("|", F.when(c.rlike(rx.STREET), "street"), F.when(c.rlike(rx.USA), "usa"), F.when(c.rlike(rx.ENUMERATED), "listed"), F.when(c.rlike(rx.PRESENT_ADDRESS), "present")))
cases("rx_17_title_label", [("'Title: The Study of Size ' || p_size", "The Study of Size"), ("'full title. A Long Enough One'", "A Long Enough One"), ("'Manuscript  Title : Nine chars'", "Nine chars"), ("'Title: short'", None), ("'Titles: The Study of Size'", None), ("'The title: The Study of Size'", None)],
      "title", "VARCHAR", lambda c: F.regexp_replace(group(marks.TITLE_LABEL, 2)(c), r"(?<=Size) \d+$", ""))
cases("rx_18_abstract_label", [("'Introduction: we ' || p_size", "introduction"), ("' METHODS'", "methods"), ("'Materials and methods:'", "materials and methods"), ("'Aim'", "aim"), ("'Aimless'", None), ("'Results of it'", None), ("'Our methods: x'", None)], "label", "VARCHAR", lambda c: F.lower(group(marks.LABEL, 1)(c)))
cases("rx_18_glued_label", [("'MethodsWe asked ' || p_size", True), ("'Results We saw'", True), ("'Conclusion. So it is'", True), ("'Background– it is'", True), ("'Background – it is'", False), ("'Methods'", True), ("'Methodsof'", True), ("'Findings'", False)], "hit", "BOOLEAN", fits(marks.GLUED_LABEL))
cases("rx_18_mid_label", [("'as known.Introduction: we ' || p_size", None), ("'knownIntroduction: we see'", "Introduction"), ("'size ' || p_size || 'Aims: to see'", "Aims"), ("'the Aims: to see'", None), ("'knownMethods: we'", None)], "label", "VARCHAR", group(marks.MID_LABEL, 1))
cases("rx_19_bare_entry", [("'9 Deng S'", True), ("'123 Hager'", True), ("'1234 Hager'", False), ("'9 deng'", False), ("' 9 Deng'", False), ("'9. Deng ' || p_size", False)], "hit", "BOOLEAN", fits(rx.BARE_REFERENCE))
cases("rx_19_form_field", [("'Journal: x'", True), ("'Author List : ' || p_size", True), ("'Running head:'", True), ("'running head:'", False), ("'The Title: x'", False), ("'Manuscript x'", False)], "hit", "BOOLEAN", fits(marks.FORM_FIELD))
cases("rx_20_page_number", [("'Page ' || (p_size % 90)", True), ("' 3 of 12 '", True), ("'12345'", False), ("'page'", False), ("'3 of'", False), ("'PAGE 1 of ' || (p_size % 90)", True)], "hit", "BOOLEAN", fits(rx.PAGE_NUMBER))
cases("rx_21_doi", [("'see doi:10.1000/Ab.' || p_size || ').'", "'doi:10.1000/Ab.' || n || ')'"), ("'https://doi.org/10.12345/x_y;z,'", "https://doi.org/10.12345/x_y;z"), ("'10.123/x'", None), ("'doi: 10.1000/a b'", "doi: 10.1000/a"), ("'x10.1000/a'", None)], "doi", "VARCHAR", ct.first_doi)
cases("rx_22_numbers_at_end", [("'A. B. J Test. 2020;5(2):11-19.'", True), ("'J. 1999; 12A (suppl) : S1 - S9'", True), ("'J. 2020;5'", True), ("'J. 2020;5(2):11-19. More'", False), ("'J 2020;5'", False), ("'J. 3020;5'", False)], "hit", "BOOLEAN", fits(rf"(?i){ct.NUMBERS}"))
cases("rx_23_separate_numbers", [("'J Test 2020;5(2):11-19.'", "2020;5(2):11-19"), ("'J Test 2020; 12:e' || p_size", "'2020; 12:e' || n"), ("'J Test 2020;5'", ct.NO_NUMBERS), ("'2020;5:1'", ct.NO_NUMBERS)], "numbers", "VARCHAR", ct.separate_numbers)
cases("rx_24_page_info", [("'J. 2020;5(2):11-19.'", "2020|5|2|11-19"), ("'J. 2020 Dec 3; 7 Suppl 2 (4) : e5'", "2020 Dec 3|7 Suppl 2|4|e5"), ("'12 Mar;:'", "12 Mar|||"), ("';:'", "|||"), ("'2020;5(2)'", "|||"), ("'x; y; 2019;4:7'", "2019|4||7"), ("'no numbers ' || p_size", "|||")], "parts", "VARCHAR",
      lambda c: tx.let(ct.page_info(c), lambda x: F.concat_ws("|", *[F.coalesce(x[k], F.lit("")) for k in ("year", "volume", "issue", "pages")])))
cases("rx_25_abbreviations", [("'The MRI of SARS-CoV-2'", "uppercase:MRI|scientific:SARS-CoV-2"), ("'in the U.S. and e.g. here'", "dotted:U.S."), ("'p53 and 3T'", "gene:p53|gene:3T"), ("'mRNA of TNF-α'", "camel:mRNA|scientific:TNF-α"), ("'H2O and NaCl'", "gene:H2O|chemical:NaCl"), ("'the AND for CI'", ""), ("'β-actin'", "greek:β-actin"), ("'plain ' || p_name", "")],
      "found", "VARCHAR", lambda c: F.array_join(F.transform(tt.abbreviations_udf()(c), lambda x: F.concat(x["type"], F.lit(":"), x["text"])), "|"))


# Candidates by form alone (RULE-04): level, strength and confidence of every branch.
_BRANCHES = [("'METHODS'", "1|3|0.9"), ("'Methods'", "2|1|0.75"), ("'1. Study sample'", "2|1|0.75"), ("'Keywords: part ' || p_size", "1|1|0.85"), ("'Funding: None.'", "2|1|0.7"), ("'FUNDING: NONE.'", "2|1|0.85"),
             ("'Results: we found ' || p_size || ' things that matter to many of us'", "3|1|0.7"), ("'GREAT BIG SIZES'", "1|3|0.65"), ("'an ordinary line of words'", None)]
BRANCHES = "SELECT p_partkey AS doc_id, CASE p_partkey % 9 " + " ".join(f"WHEN {k} THEN {s}" for k, (s, _) in enumerate(_BRANCHES)) + " END AS raw FROM {part}"


@derived("rule_04_levels_and_confidence", BRANCHES, "SELECT doc_id, CASE doc_id % 9 " + " ".join(f"WHEN {k} THEN '{v}'" for k, (_, v) in enumerate(_BRANCHES) if v) + " END AS shown FROM i")
def levels_and_confidence(i):
    c = headings.screened(read_blocks(i)).select("doc_id", "cand")
    return c.select("doc_id", F.concat_ws("|", *[F.col(f"cand.{x}").cast("string") for x in ("level", "strength", "conf")]).alias("s")).select("doc_id", F.nullif("s", F.lit("")).alias("shown"))


@derived("flt_11_roles_without_headings", "SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN 'TABLE 1. METHODS' WHEN 1 THEN 'METHODS: ' || p_size WHEN 2 THEN 'PHONE: 12345' ELSE 'WORD COUNT: ' || p_size END AS raw FROM {part}",
         "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'caption' WHEN 2 THEN 'contact' WHEN 3 THEN 'metadata_count' END AS role, doc_id % 4 = 1 AS is_candidate FROM i")
def roles_without_headings(i):
    return headings.screened(read_blocks(i)).select("doc_id", "role", F.col("cand").isNotNull().alias("is_candidate"))


# Small functions with cases of their own.
cases("fn_04_match", [("'Method'", "methods"), ("'3 Methods'", "methods"), ("'2020 methods'", None), ("'Materials &  Methods.'", "methods"), ("'Study Design'", "study_sample"), ("repeat('methods ', 40)", None), ("p_name", None)], "type", "VARCHAR",
      lambda c: tx.let(lx.normalize(F.when(F.length(c) <= 200, c))["norm"], lambda n: F.try_element_at(F.create_map(*[F.lit(x) for kv in lx.TYPE_OF.items() for x in kv]), n)))
cases("fn_05_glued_prefix", [("'FundingNone'", "funding"), ("'funding none'", None), ("'Ethics approval:x'", "ethics approval"), ("'EthicsApproval'", "ethics"), ("'Abstractof'", None), ("'Results2'", "results"), ("p_name", None)], "variant", "VARCHAR", lx.glued_prefix)
cases("fn_06_title_case_ratio", [("'The Size of a Part'", 1.0), ("'The size Of it'", 0.0), ("'one Two'", 0.5), ("'12 34'", 0.0), ("''", 0.0)], "ratio", "DOUBLE", lambda c: tx.title_case_ratio(c).cast("double"))
cases("fn_13_font_name", [("' Franklin  Gothic '", "franklin gothic"), ("'ARIAL' || chr(9) || 'Narrow'", "arial narrow"), ("NULL", "")], "font", "VARCHAR", tx.normalize_font_name)
cases("fn_15_headline_case", [("'Study Sample 2'", True), ("'Study sample'", False), ("'study'", False), ("'12 34'", False), ("'A-b'", False), ("'METHODS'", True), ("''", False)], "hit", "BOOLEAN", tx.is_headline_case)
cases("fn_16_sentence_case", [("'Data were clean.'", True), ("'Data Were clean'", False), ("'data'", False), ("'Data'", True), ("'2 Data here'", True), ("''", False), ("'É data'", False)], "hit", "BOOLEAN", tx.is_sentence_case)
cases("fn_17_capitalize_token", [("'of DNA'", "Of DNA"), ("'size of mRNA'", "Size of mRNA"), ("'THE A of'", "THE a of"), ("'α-cell in x'", "α-Cell in X"), ("'up-to-date'", "Up-to-Date")], "shown", "VARCHAR", tt.capitalize_expansion)
cases("fn_20_list_to_string", [("'a,b'", "a | b"), ("'a'", "a"), ("''", ""), ("NULL", "")], "shown", "VARCHAR", lambda c: tx.list_to_string(F.split(c, ",")))
cases("fn_48_surname", [("'Ana da Costa'", "da Costa A"), ("'Vincent van der Berg'", "van der Berg V"), ("'Plato'", "Plato"), ("'de Gaulle'", "de Gaulle"), ("'  Mary   Lee '", "Lee M"), ("''", "")], "shown", "VARCHAR", ct.format_author)
cases("fn_49_initials", [("'Rui de Melo Pinto'", "Pinto RdeM"), ("'Mary Ann Lee'", "Lee MA"), ("'Pinto, Rui A'", "Pinto R A"), ("'da Costa, ana maria'", "da Costa ana maria"), ("'Élan Été'", "Été É"), ("'Lee,'", "Lee")], "shown", "VARCHAR", ct.format_author)
cases("flt_10_named_only", [("'[\"a\", \"\", null, \"b\"]'", "a|b"), ("'[]'", ""), ("'[null]'", ""), ("NULL", None)], "names", "VARCHAR", lambda c: F.array_join(F.filter(F.from_json(c, "array<string>"), lambda x: x.isNotNull() & (x != "")), "|"))
cases("sort_04_abbreviation_order", [("'SARS-CoV-2 IL-6'", "0-10|11-15"), ("'U.S.A. MRI'", "0-6|7-10"), ("p_name", "")], "spans", "VARCHAR", lambda c: F.array_join(F.transform(tt.abbreviations_udf()(c), lambda x: F.concat_ws("-", x["start"], x["end"])), "|"))
cases("sort_03_longest_name", [("'Ethics approval and consent to participateNone'", "ethics approval and consent to participate"), ("'Funding sourcesNone'", "funding sources"), ("'FundingNone'", "funding")], "variant", "VARCHAR", lx.glued_prefix)


cases("fn_63_clamp_and_bonus", [("'0.9'", 0.95), ("'0.95'", 0.97), ("'0.05'", 0.2), ("'0.75'", 0.8)], "conf", "DOUBLE", lambda c: F.round(F.least(F.lit(0.97), F.greatest(F.lit(0.15), c.cast("double")) + 0.05), 6))
