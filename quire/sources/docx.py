"""DOCX files as blocks, excluded streams and warnings. Standard library only.

A file is parsed where its row is; files are independent, so reading is one pass without a shuffle. Tracked changes are accepted or
rejected by ``mode``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.sequences import inherited
from quire.sources.text_reader import RUN, features

# The namespaces of the format and its transparent elements.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
TRANSPARENT = {"hyperlink", "smartTag", "fldSimple", "sdtContent", "dir", "bdo", "customXml"}
SILENT = {"pPr", "bookmarkStart", "bookmarkEnd", "proofErr", "commentRangeStart", "commentRangeEnd", "commentReference", "moveFromRangeStart", "moveFromRangeEnd", "moveToRangeStart", "moveToRangeEnd", "permStart", "permEnd",
          "ins_placeholder", "del_placeholder", "oMath", "oMathPara", "sectPr"}
PARTS = {"footnotes": "word/footnotes.xml", "endnotes": "word/endnotes.xml", "comments": "word/comments.xml"}
RICH = ("font", "size", "u", "strike", "color", "highlight", "valign")
PLAIN = ("bold", "italic", "caps")
BLOCKS = f"idx int, text string, runs array<{RUN}>, style string, style_name string, outline int, jc string, blank_before int, page_break_before boolean, is_table boolean, is_list boolean, merged_from int, start int, `end` int"
DOCUMENT = f"blocks array<struct<{','.join(x.strip().replace(' ', ':', 1) for x in re.split(r', (?=[a-z`]+ )', BLOCKS))}>>, excluded array<struct<stream:string,part:string,text:string>>, warnings array<string>, error string"


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def value(e: ET.Element | None, name: str = "val") -> str | None:
    return None if e is None else e.get(W + name)


def child_value(e: ET.Element | None, tag: str) -> str | None:
    return None if e is None else value(e.find(W + tag))


def toggle(e: ET.Element | None) -> bool | None:
    """On without a value; off for 0, false and none; null if the element is absent."""
    if e is None:
        return None
    v = value(e)
    return v is None or v.lower() not in ("0", "false", "none")


def number(v: str | None) -> int | None:
    try:
        return int(v)
    except (TypeError, ValueError):
        return None


def run_properties(rpr: ET.Element | None, theme: dict[str, str]) -> dict:
    """What one set of run properties says; null where it says nothing."""
    out: dict = dict.fromkeys(PLAIN + RICH)
    if rpr is None:
        return out
    for key, tag in (("bold", "b"), ("italic", "i"), ("caps", "caps"), ("strike", "strike")):
        out[key] = toggle(rpr.find(W + tag))
    fonts = rpr.find(W + "rFonts")
    if fonts is not None:
        ref = value(fonts, "asciiTheme") or value(fonts, "hAnsiTheme") or ""
        out["font"] = value(fonts, "ascii") or value(fonts, "hAnsi") or theme.get(next((k for k in ("minor", "major") if ref.startswith(k)), "")) or None
    half = number(child_value(rpr, "sz"))
    out["size"] = None if half is None else half / 2
    if rpr.find(W + "u") is not None:
        out["u"] = child_value(rpr, "u") or "single"
    for key, tag in (("color", "color"), ("highlight", "highlight"), ("valign", "vertAlign")):
        out[key] = child_value(rpr, tag) or None
    off = {"u": "none", "color": "auto", "highlight": "none", "valign": "baseline"}
    return {k: None if k in off and v == off[k] else v for k, v in out.items()}


@dataclass
class Styles:
    theme: dict[str, str] = field(default_factory=dict)
    own: dict[str, dict] = field(default_factory=dict)  # by style: properties, name, outline and basedOn
    defaults: dict = field(default_factory=dict)
    paragraph: str = ""

    @classmethod
    def load(cls, parts: dict[str, bytes]) -> Styles:
        out = cls()
        theme, sheet = tree(parts.get("word/theme/theme1.xml")), tree(parts.get("word/styles.xml"))
        for kind in ("minor", "major"):
            latin = None if theme is None else theme.find(f".//{A}{kind}Font/{A}latin")
            if latin is not None and latin.get("typeface"):
                out.theme[kind] = latin.get("typeface")
        if sheet is None:
            return out
        out.defaults = run_properties(sheet.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr"), out.theme)
        for s in sheet.findall(W + "style"):
            name = value(s, "styleId") or ""
            if value(s, "default") == "1" and value(s, "type") == "paragraph":
                out.paragraph = name
            out.own[name] = run_properties(s.find(W + "rPr"), out.theme) | {"name": child_value(s, "name") or name, "based_on": child_value(s, "basedOn"), "outline": number(child_value(s.find(W + "pPr"), "outlineLvl"))}
        return out

    def get(self, style: str | None, key: str):
        """The first value up the chain of basedOn; chains that loop end."""
        seen = set()
        while style and style not in seen and style in self.own:
            seen.add(style)
            if self.own[style][key] is not None:
                return self.own[style][key]
            style = self.own[style]["based_on"]
        return None

    def resolve(self, direct: dict, run_style: str | None, para_style: str) -> dict:
        """Direct formatting, run style, paragraph style, document defaults. The last two levels are open to plain toggles only as far
        as the paragraph has a style of its own."""
        out = {}
        for key in PLAIN + RICH:
            chain = (run_style, para_style if key in PLAIN else para_style or self.paragraph)
            found = [direct[key], *(self.get(s, key) for s in chain), None if key in PLAIN else self.defaults.get(key)]
            out[key] = next((v for v in found if v is not None), None)
        return out


def tree(xml: bytes | None) -> ET.Element | None:
    try:
        return None if xml is None else ET.fromstring(xml)
    except ET.ParseError:
        return None


@dataclass(frozen=True)
class Run:
    text: str
    props: tuple


@dataclass
class Paragraph:
    runs: list[Run]
    style: str
    jc: str
    outline: int | None
    page_break: bool
    is_list: bool
    joins_next: bool
    merged: int = 1


class Reader:
    def __init__(self, data: bytes, mode: str = "accept") -> None:
        if mode not in ("accept", "reject"):
            raise ValueError("mode is accept or reject")
        self.dropped = ("del", "moveFrom") if mode == "accept" else ("ins", "moveTo")
        self.mode = mode
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            self.parts = {n: z.read(n) for n in z.namelist() if n.startswith("word/") and n.endswith(".xml")}
        self.styles = Styles.load(self.parts)
        self.unhandled: set[str] = set()

    def run_text(self, r: ET.Element) -> tuple[str, bool]:
        out, page = [], False
        for e in r:
            tag = local(e)
            if tag == "t" or tag == "delText" and self.mode == "reject":
                out.append(e.text or "")
            elif tag == "tab":
                out.append("\t")
            elif tag in ("br", "cr"):
                page |= value(e, "type") == "page"
                out.append("\n")
            elif tag == "noBreakHyphen":
                out.append("-")
            elif tag == "lastRenderedPageBreak":
                page = True
        return "".join(out), page

    def runs(self, e: ET.Element, style: str) -> Iterator[tuple[Run | None, bool]]:
        """Runs of a paragraph and whether each breaks the page."""
        for c in e:
            tag = local(c)
            if tag == "r":
                text, page = self.run_text(c)
                rpr = c.find(W + "rPr")
                if text:
                    props = self.styles.resolve(run_properties(rpr, self.styles.theme), child_value(rpr, "rStyle"), style)
                    yield Run(text, tuple(props.items())), page
                elif page:
                    yield None, page
            elif tag in ("ins", "del", "moveTo", "moveFrom"):
                if tag not in self.dropped:
                    yield from self.runs(c, style)
            elif tag == "sdt" and (inner := c.find(W + "sdtContent")) is not None:
                yield from self.runs(inner, style)
            elif tag in TRANSPARENT:
                yield from self.runs(c, style)
            elif tag not in SILENT and tag != "sdt":
                self.unhandled.add(tag)

    def paragraph(self, p: ET.Element) -> Paragraph:
        ppr = p.find(W + "pPr")
        has = lambda path: ppr is not None and ppr.find(path) is not None
        style = child_value(ppr, "pStyle") or ""
        outline = number(child_value(ppr, "outlineLvl"))
        if outline is None:
            outline = self.styles.get(style, "outline")
        runs = list(self.runs(p, style))
        mark = f"{W}rPr/{W}{'del' if self.mode == 'accept' else 'ins'}"
        return Paragraph([r for r, _ in runs if r is not None], style, child_value(ppr, "jc") or "", outline, has(W + "pageBreakBefore") or any(b for _, b in runs), has(W + "numPr"), has(mark))

    def table_text(self, table: ET.Element) -> str:
        def cell(c: ET.Element) -> str:
            texts = ("".join(r.text for r in self.paragraph(p).runs).strip() for p in c.iter(W + "p"))
            return " ".join(t for t in texts if t)

        return "\n".join("\t".join(cell(c) for c in row.findall(W + "tc")) for row in table.iter(W + "tr"))

    def items(self, container: ET.Element) -> Iterator[ET.Element]:
        for c in container:
            if local(c) in ("p", "tbl"):
                yield c
            elif local(c) == "sdt" and (inner := c.find(W + "sdtContent")) is not None:
                yield from self.items(inner)

    def units(self, body: ET.Element) -> Iterator[Paragraph | str]:
        """Paragraphs, joined over removed paragraph marks, and tables as texts. A join never crosses a table."""
        open_: Paragraph | None = None
        for e in self.items(body):
            if local(e) == "tbl":
                if open_ is not None:
                    yield open_
                    open_ = None
                yield self.table_text(e)
                continue
            p = self.paragraph(e)
            if open_ is not None:
                p = replace(open_, runs=open_.runs + p.runs, merged=open_.merged + 1, page_break=open_.page_break or p.page_break, joins_next=p.joins_next)
                open_ = None
            if p.joins_next:
                open_ = p
            else:
                yield p
        if open_ is not None:
            yield open_

    def blocks(self) -> list[dict]:
        root = ET.fromstring(self.parts["word/document.xml"])
        body = root.find(W + "body")
        if body is None:
            raise ValueError("the document has no body")
        out: list[dict] = []
        blank, page, at = 0, False, 0

        def add(text: str, runs: list[Run], page_break: bool, p: Paragraph | None) -> None:
            nonlocal blank, page, at
            named = p.style if p else None
            out.append({
                "idx": len(out), "text": text, "runs": [as_run(r) for r in runs], "style": named, "style_name": None if p is None else self.styles.own.get(named, {}).get("name", named) if named else "",
                "outline": p.outline if p else None, "jc": p.jc if p else None, "blank_before": blank, "page_break_before": page_break, "is_table": p is None, "is_list": bool(p and p.is_list),
                "merged_from": p.merged if p else 1, "start": at, "end": at + len(text),
            })
            at += len(text) + 1
            blank, page = 0, False

        for u in self.units(body):
            if isinstance(u, str):
                if u.strip():
                    add(u, [], page, None)
                continue
            if not "".join(r.text for r in u.runs).strip():
                blank += 1
                page |= u.page_break
                continue
            first = True
            for line in soft_lines(u.runs):  # soft breaks part lines that are blocks of their own
                text = "".join(r.text for r in line)
                if not text.strip():
                    blank += 1
                    continue
                add(text, line, first and (u.page_break or page), u)
                first = False
        return out

    def flat_text(self, xml: bytes) -> str:
        root = tree(xml)
        if root is None:
            return ""
        out: list[str] = []
        todo = [root]
        while todo:
            e = todo.pop()
            if self.mode == "accept" and local(e) == "del":
                continue
            if e.tag == W + "t" and e.text:
                out.append(e.text)
            todo += reversed(e)
        return " ".join(out)

    def excluded(self) -> list[dict]:
        named = [(m[1] + "s", n) for n in sorted(self.parts) if (m := re.match(r"word/(header|footer)\d+\.xml$", n))]
        named += [(k, n) for k, n in PARTS.items() if n in self.parts]
        found = [{"stream": k, "part": n, "text": self.flat_text(self.parts[n]).strip()} for k, n in named]
        return [x for x in found if x["text"]]

    def warnings(self) -> list[str]:
        return ["unhandled elements: " + ", ".join(sorted(self.unhandled))] if self.unhandled else []


def soft_lines(runs: list[Run]) -> list[list[Run]]:
    out: list[list[Run]] = [[]]
    for r in runs:
        for k, part in enumerate(r.text.split("\n")):
            if k:
                out.append([])
            if part:
                out[-1].append(replace(r, text=part))
    return out


def as_run(r: Run) -> dict:
    p = dict(r.props)
    return {"text": r.text, **{k: bool(p[k]) for k in PLAIN}, "font_name": p["font"], "font_size": p["size"], "underline": p["u"], "strike": bool(p["strike"]), "color": p["color"], "highlight": p["highlight"], "vert_align": p["valign"]}


def read_document(data: bytes | None, mode: str = "accept") -> dict:
    """Blocks, excluded streams and warnings of one file; an error instead if it cannot be read."""
    try:
        r = Reader(data or b"", mode)
        return {"blocks": r.blocks(), "excluded": r.excluded(), "warnings": r.warnings(), "error": None}
    except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError) as e:
        return {"blocks": [], "excluded": [], "warnings": [], "error": f"{type(e).__name__}: {e}"}


def read_docx(files: DataFrame, doc_id: str = "path", content: str = "content", mode: str = "accept") -> DataFrame:
    """doc_id, blocks, excluded, warnings, error: one row per file. Null contents and damaged files give an error."""
    rows = files.select(F.col(doc_id).alias("doc_id"), F.col(content).alias("content"))
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(DOCUMENT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in schema.fields[1:]]
        for batch in batches:
            for k in range(0, batch.num_rows, 16):  # few files at a time: blocks are larger than files
                part = batch.slice(k, 16)
                docs = [read_document(x, mode) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([d[f.name] for d in docs], t) for f, t in zip(schema.fields[1:], types))], schema.names)

    return rows.mapInArrow(run, schema)


def docx_blocks(documents: DataFrame) -> DataFrame:
    """The blocks of documents that read_docx() returned, with their features."""
    rows = documents.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.*")
    return features(rows)


def resolve_inheritance(styles: DataFrame, value_column: str) -> DataFrame:
    """styles: doc_id, style_id, based_on and a value. doc_id, style_id and the first value up the chain of based_on."""
    return inherited(styles, "style_id", "based_on", value_column)


def make_docx(paragraphs: list[tuple[str, dict]], extra: dict[str, str] | None = None) -> bytes:
    """A small file for tests and examples: (XML of the runs, paragraph properties as XML by key 'ppr')."""
    body = "".join(f"<w:p>{'<w:pPr>' + p['ppr'] + '</w:pPr>' if p.get('ppr') else ''}{runs}</w:p>" if not runs.startswith("<w:tbl") else runs for runs, p in paragraphs)
    wrap = lambda tag, x: f'<w:{tag} xmlns:w="{W[1:-1]}">{x}</w:{tag}>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("word/document.xml"), wrap("document", f"<w:body>{body}</w:body>"))
        for name, xml in (extra or {}).items():
            z.writestr(zipfile.ZipInfo(name), xml.replace("XMLNS", f'xmlns:w="{W[1:-1]}"'))
    return out.getvalue()
