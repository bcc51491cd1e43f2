"""HTML extraction with site template removal.

Each page becomes a tree of elements. A subtree's hash covers its tags and text, but no attributes, so that numbers in ids and classes
do not hide that it recurs. The hashes of all blocks of a page, whatever their kind and names, are counted once per host and distinct
main text in Spark, so that copies of a page count as one; a subtree that recurs on many pages of its host is template and is deleted
before anything else is judged, unless it is a text block of the article or holds most of its text. Then what recurs too seldom to be
known as template goes by kind (navigation, forms, scripts ...) or by role and class names. What remains are the article's blocks.

Names that articles use for their own parts, too (discussion, notice, related ...), delete nothing inside an article by themselves: there,
such an element goes only if its structure (its name and its tags, without texts) recurs on the host, and it is neither a text block nor
has a heading of its own. Articles that share their parent with the longest one are all kept.

Parsing is one pass forward, and every step on the tree is one pass, too: time grows with a page's length whatever its markup and depth.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import settle
from quire.llm.url_filter import host_of

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body br canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul video".split()
)
#: Elements without main text.
DROP = frozenset("head script style noscript template nav header footer aside form button select option textarea input label fieldset iframe object embed svg canvas audio video map dialog menu search title".split())
#: An open element of the value ends when an element of the key starts, without leaving the scope.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th", "tbody"}, "tfoot": {"tr", "td", "th", "tbody", "thead"},
} | {k: {"p"} for k in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()}
SCOPE = frozenset("html body table td th ul ol dl article section div main aside nav header footer form blockquote figure details fieldset".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span sub sup mark".split())

#: Class, id and role values that mark what is no main text, as whole values or as their last word.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot adunit adsbygoogle adsense banner banners sponsor sponsored promo promos promoted promotion "
    "nav navbar navigation subnav topnav menu menus menubar breadcrumb breadcrumbs sidebar sidebars side aside widget widgets footer header masthead topbar "
    "cookie cookies cookiebar consent gdpr privacy notice notices announcement alert alerts popup popups modal overlay newsletter subscribe subscription paywall signup login search "
    "share sharing social related recommended recommendations comment comments commentlist usercomments feedback reply replies discussion disqus respond pagination pager toolbar skip "
    "complementary contentinfo".split()
)
#: Those of them that also name parts of an article: inside one they need to recur on their host.
DOUBTFUL = frozenset(
    "discussion privacy notice notices announcement alert alerts search related social recommended recommendations comment reply replies feedback respond side aside banner header "
    "footer overlay modal popup popups consent subscription login signup skip promotion share sharing toolbar".split()
)
#: The same, as whole values (without digits, words joined by -), which are never doubtful.
BOILERPLATE_NAMES = frozenset(
    "cookie-notice privacy-notice site-notice site-header site-footer page-header page-footer comment-reply reader-comment user-comment ad-box ad-container ad-slot ad-unit ad-wrapper banner-ad-container comment-list comments-area comments-list comments-section cookie-bar cookie-banner-container "
    "footer-bottom footer-links footer-widgets nav-bar nav-links nav-list menu-items newsletter-form related-articles related-content related-links related-posts "
    "share-bar share-buttons share-links sidebar-left sidebar-right sidebar-primary sidebar-secondary social-links social-media-links sponsored-content widget-area".split()
)
#: Names that say what a wrapper has or lacks, not what it is.
LAYOUT = re.compile(r"(?:has|with|without|no|is|hide|show)[-_]")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Recurring text blocks of these kinds inside the article are text, not template.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th figcaption article main body html section".split())

#: A subtree that is on at least so many distinct pages of a host, and on at least this share of them, is template;
#: on MANY_PAGES it is whatever the share, so that large hosts need no more.
MIN_PAGES, MIN_SHARE = 3, 0.02
MANY_PAGES = 100

#: Elements that never show, so that their recurrence says nothing.
UNSEEN = frozenset("head script style noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element's kind and names say of it.
KEPT, IN_DOUBT, NAMED, NO_TEXT = range(4)

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    attributes: str = ""
    children: list[Node | str] = field(default_factory=list)
    hash: int = 0
    #: Hash of name and structure of an element in doubt, else 0.
    mark: int = 0
    state: int = KEPT
    #: Characters of text without and with what kinds and names would drop.
    size: int = 0
    full: int = 0


class _Open:
    """The open elements. Where the last one of a tag, block or scope is, is known without a walk, so that closing costs what it closes."""

    def __init__(self, root: Node) -> None:
        self.nodes = [root]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []

    def last(self, tag: str) -> int:
        """The place of the last open element of the tag; 0 (the root's) if there is none."""
        places = self.at.get(tag)
        return places[-1] if places else 0

    def push(self, node: Node) -> None:
        n = len(self.nodes)
        self.nodes.append(node)
        self.at.setdefault(node.tag, []).append(n)
        if node.tag in BLOCK:
            self.blocks.append(n)
        if node.tag in SCOPE:
            self.scopes.append(n)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            self.at[self.nodes.pop().tag].pop()
        for places in (self.blocks, self.scopes):
            while places and places[-1] >= place:
                places.pop()

    def imply(self, ends: set[str]) -> None:
        place = max(map(self.last, ends))
        if place and place >= (self.scopes[-1] if self.scopes else 0):
            self.cut(place)

    def close(self, tag: str) -> None:
        place = self.last(tag)
        limit = self.blocks if tag in FORMATTING else self.scopes if tag == "p" else ()  # formatting does not close blocks
        if place and not (limit and limit[-1] > place):
            self.cut(place)


class _Tags:
    """Finds the ends of tags. A quote that is never closed ends with its tag; that there is none is remembered, not looked for again."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.none = {'"': False, "'": False}

    def end(self, at: int) -> int:
        """The place of the > that ends the tag whose attributes start here; -1 if the page ends first."""
        while (m := STOP.search(self.page, at)) is not None:
            if m[1] is None:
                return m.start()
            close = -1 if self.none[m[1]] else self.page.find(m[1], m.end())
            if close < 0:
                self.none[m[1]] = True
                return self.page.find(">", m.end())
            at = close + 1
        return -1


def parse(page: str) -> Node:
    """A tree from any markup: unclosed and stray tags never fail, and elements close as HTML closes them. A tag that the page's end cuts
    off is dropped."""
    root = Node("html")
    stack = _Open(root)
    tags = _Tags(page)
    at = shown = 0
    while (at := page.find("<", at)) >= 0:
        opens = page[at + 1 : at + 2]
        closing = opens == "/"
        name = NAME.match(page, at + 1 + closing)
        if opens in ("!", "?"):
            stop = page.find("-->", at + 4) + 2 if page.startswith("<!--", at) else page.find(">", at)
            stop = -1 if stop < at + 2 else stop
        elif name is None:
            at += 1
            continue
        else:
            stop = tags.end(name.end())
        if at > shown:
            stack.nodes[-1].children.append(page[shown:at])
        at = stop + 1
        if stop < 0:
            return root
        shown = at
        if name is None or opens in ("!", "?"):
            continue
        tag, attributes = name[0].lower(), page[name.end() : stop]
        if closing:
            stack.close(tag)
            continue
        if tag == "html" or tag == "body" and stack.last("body"):
            continue
        if tag == "body" or tag in BLOCK and stack.nodes[-1].tag == "head" and tag != "title":
            stack.close("head")
        if (ends := CLOSES.get(tag)) is not None:
            stack.imply(ends)
        node = Node(tag, attributes)
        stack.nodes[-1].children.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK and tag not in FORMATTING and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            stop = end.start() if end else len(page)
            node.children.append(page[at:stop])
            at = shown = end.end() if end else len(page)
            continue
        stack.push(node)
    if shown < len(page):
        stack.nodes[-1].children.append(page[shown:])
    return root


def judged(tag: str, attributes: str) -> tuple[int, str]:
    """What kind and names say of an element, and the name that puts it in doubt."""
    if tag in DROP:
        return NO_TEXT, ""
    if tag in ("html", "body", "article", "main") or not attributes or attributes.isspace():
        return KEPT, ""
    state, doubt = KEPT, ""
    for name, *values in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            for token in "".join(values).lower().split():
                if LAYOUT.match(token) or not (words := WORDS.findall(token)):
                    continue
                if "-".join(words) in BOILERPLATE_NAMES or words[-1] in BOILERPLATE - DOUBTFUL:
                    state = NAMED
                elif words[-1] in DOUBTFUL:
                    state, doubt = max(state, IN_DOUBT), doubt or "-".join(words)
        elif name == "hidden" or name == "aria-hidden" and "".join(values).lower() == "true" or name == "style" and HIDDEN.search("".join(values)):
            return NO_TEXT, ""
    return state, doubt


def hash_tree(root: Node) -> None:
    """Sets hash, mark, state and sizes of every element, from the leaves up; white space is one space. No recursion.

    The hash is of the tag and the children; the mark is of the name in doubt and of the tags alone, where equal ones in a row are one."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    shapes: dict[int, int] = {}
    for node in reversed(order):
        h, shape, last = xxhash.xxh64(node.tag.encode()), xxhash.xxh64(node.tag.encode(), seed=1), None
        node.state, doubt = judged(node.tag, node.attributes)
        for c in node.children:
            if isinstance(c, Node):
                h.update(c.hash.to_bytes(8, "little"))
                if (own := shapes.pop(id(c))) != last:
                    shape.update(own.to_bytes(8, "little"))
                    last = own
                if c.state != NO_TEXT:
                    node.full += c.full
                    node.size += c.size if c.state == KEPT else 0
                continue
            if t := SPACE.sub(" ", c).strip():
                h.update(b"\0" + t.encode("utf-8", "surrogatepass"))
            node.size += len(c)
            node.full += len(c)
        node.hash = h.intdigest()
        shapes[id(node)] = shape.intdigest()
        if node.state == IN_DOUBT and node.tag in BLOCK and node.tag not in TEXT_BLOCKS and not any(isinstance(c, Node) and c.tag in HEADINGS for c in node.children):
            node.mark = xxhash.xxh64_intdigest(doubt.encode() + shape.digest(), seed=2)


def dropped(node: Node, names: bool = True) -> bool:
    """Whether an element is no main text by kind, or (with names) by what its class, id or role says. For elements outside an article."""
    return node.state >= (IN_DOUBT if names else NO_TEXT)


def articles_of(root: Node) -> list[Node]:
    """The main or article element with most text, and with an article those that share its parent; else the whole page. One inside an
    element that its name would drop counts if there is no other and it holds most of the page's text: then the name is that of a wrapper."""
    best, size = _longest_articles(root, True)
    if best[0] is root:
        wrapped, size = _longest_articles(root, False)
        if wrapped[0] is not root and 2 * size > root.full:
            return wrapped
    return best


def _longest_articles(root: Node, names: bool) -> tuple[list[Node], int]:
    best, parent, size = root, root, 0
    todo = [root]
    while todo:
        node = todo.pop()
        for c in node.children:
            if isinstance(c, str) or dropped(c, names):
                continue
            if c.tag in ("article", "main") and c.size > size:
                best, parent, size = c, node, c.size
            if c.tag != "article":  # an article inside an article is a comment or a teaser of it
                todo.append(c)
    if best.tag != "article":
        return [best], size
    beside = [c for c in parent.children if isinstance(c, Node) and c.tag == "article" and (c is best or judged("div", c.attributes)[0] == KEPT)]
    return beside, sum(c.size for c in beside)


def candidates(root: Node, articles: list[Node]) -> set[int]:
    """Hashes of the block elements that could be template: all outside the articles, and the articles' own that are no text; marks of the
    articles' elements in doubt."""
    found: set[int] = set()
    todo: list[tuple[Node, bool]] = [(root, False)]
    tops = set(map(id, articles))
    while todo:
        node, inside = todo.pop()
        top = id(node) in tops
        inside = inside or top
        if node.tag in BLOCK and node is not root and not top and not (inside and node.tag in TEXT_BLOCKS and articles[0] is not root):
            found.add(node.hash)
        if inside and not top and node.mark:
            found.add(node.mark)
        todo += [(c, inside) for c in node.children if isinstance(c, Node) and c.tag not in UNSEEN]
    return found


def text_blocks(article: Node, template: frozenset[int] | set[int], whole_page: bool = False) -> Iterator[str]:
    """The blocks of an element in page order: white space is one space, references are decoded. On a page without an article
    (whole_page) names in doubt drop by themselves."""
    limit = IN_DOUBT if whole_page else NAMED
    parts: list[str] = []
    # entries: a node to visit, a text, or None for the end of a block
    todo: list[Node | str | None] = [article]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
            continue
        if x is not None and x is not article and (x.hash in template or x.mark in template or x.state >= limit):
            if x.tag in BLOCK:
                x = None
            else:
                continue
        block = x is None or x.tag in BLOCK
        if block and parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                yield text
        if x is not None:
            if block:
                todo.append(None)
            todo += reversed(x.children)
    if text := " ".join(entities.unescape("".join(parts)).split()):
        yield text


def kept_text(root: Node, articles: list[Node], template: frozenset[int]) -> set[int]:
    """Hashes of recurring subtrees that are no template, since they hold most of the articles' text: all of them together in an article
    or main element (the article itself recurs), each on its own on a page without one. Their parts are kept, too."""
    total, found, todo = sum(a.size for a in articles), [], list(articles)
    tops = set(map(id, articles))
    limit = IN_DOUBT if articles[0] is root else NAMED
    while todo:
        node = todo.pop()
        if id(node) not in tops and (node.hash in template or node.mark in template):
            n = node.size
            if articles[0] is not root or 2 * n > total:
                found.append((node, n))
                continue
        todo += [c for c in node.children if isinstance(c, Node) and c.state < limit]
    # Elements in doubt are not in the articles' sizes.
    total += sum(n for node, n in found if node.state == IN_DOUBT)
    if 2 * sum(n for _, n in found) <= total:
        return set()
    kept, todo = set(), [node for node, _ in found]
    while todo:
        node = todo.pop()
        kept |= {node.hash, node.mark}
        todo += [c for c in node.children if isinstance(c, Node)]
    return kept


def _read(page: str | None) -> tuple[Node, list[Node]]:
    root = parse(page or "")
    hash_tree(root)
    return root, articles_of(root)


def _joined(root: Node, articles: list[Node], template: frozenset[int]) -> str:
    return " ".join(t for a in articles for t in text_blocks(a, template, a is root))


def page_hashes(page: str | None) -> tuple[set[int], int]:
    """The hashes that could be template, and the hash of the page's main text."""
    root, articles = _read(page)
    text = _joined(root, articles, frozenset())
    return candidates(root, articles), xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def main_text(page: str | None, template: Iterable[int] = ()) -> str:
    root, articles = _read(page)
    template = frozenset(template) & candidates(root, articles)  # so that no text block of the article can go
    if template:
        template -= kept_text(root, articles, template)
    return _joined(root, articles, template)


def template_share(page: str | None, template: Iterable[int] = ()) -> tuple[int, int]:
    """Of a page's elements that are no main text by kind, by name or as template, outermost ones with text: how many there are, and how
    many of them are template. It tells how far counting alone goes."""
    root, articles = _read(page)
    tops = {id(root), *map(id, articles)}
    template = frozenset(template) & candidates(root, articles)
    every = known = 0
    todo = [root]
    while todo:
        node = todo.pop()
        if id(node) not in tops and node.tag not in UNSEEN and (node.hash in template or dropped(node)) and node.full:
            every, known = every + 1, known + (node.hash in template)
            continue
        todo += [c for c in node.children if isinstance(c, Node) and c.tag not in UNSEEN]
    return every, known


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def host_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, url: str = "url", html: str = "html") -> DataFrame:
    """host, h: hashes of subtrees that recur on many pages of a host. Pages with the same main text are one."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, h, d = [], [], []
            for name, page in zip(batch.column(0), batch.column(1)):
                hashes, digest = page_hashes(page.as_py())
                host += [name.as_py()] * (len(hashes) + 1)
                h += [*map(_signed, hashes), None]  # the null counts the page itself
                d += [_signed(digest)] * (len(hashes) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(h, pa.int64()), pa.array(d, pa.int64())], ["host", "h", "d"])

    counts = rows.mapInArrow(run, "host string, h bigint, d bigint").distinct().groupBy("host", "h").agg(F.count("*").alias("n"))
    counts = settle(counts.filter((F.col("n") >= min_pages) | F.col("h").isNull()))
    totals = counts.filter("h is null").select("host", F.col("n").alias("pages"))
    return counts.filter("h is not null").join(totals, "host").filter((F.col("n") >= F.col("pages") * min_share) | (F.col("n") >= MANY_PAGES)).select("host", "h")


#: Templates up to this many rows are sent to every executor; more are joined by host and hash.
MAX_BROADCAST = 200_000


def extract(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id",), url: str = "url", html: str = "html", min_pages: int = MIN_PAGES,
            min_share: float = MIN_SHARE, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per page: id_cols, url, text.

    Null html is empty and has an empty text. Null urls and urls without a host share the host ''. Pages of a host with the
    same main text count once; other columns are ignored; an empty table gives no rows."""
    templates = settle(host_templates(pages, min_pages, min_share, url, html))
    rows = pages.select(*id_cols, F.col(url).alias("url"), host_of(F.col(url)).alias("__host"), F.col(html).alias("__html"))
    schema = rows.drop("__host", "__html").withColumn("text", F.lit("")).schema

    if templates.limit(max_broadcast + 1).count() <= max_broadcast:
        known: dict[str, set[int]] = {}
        for r in templates.toLocalIterator():
            known.setdefault(r.host, set()).add(r.h & (1 << 64) - 1)
        sent = pages.sparkSession.sparkContext.broadcast(known)
        kept, template_of = rows, lambda row: sent.value.get(row[0], ())
    else:
        # The same, by a join: each page's own hashes against its host's templates, gathered per page (at most its elements).
        digest = F.xxhash64("__host", "__html")
        own = rows.select("__host", "__html").withColumn("__d", digest)
        pairs = _own_hashes(own).join(templates.withColumnRenamed("host", "__host"), ["__host", "h"])
        lists = pairs.groupBy("__host", "__d").agg(F.collect_set("h").alias("__t"))
        kept = rows.withColumn("__d", digest).join(lists, ["__host", "__d"], "left").select(*rows.columns, "__t")
        template_of = lambda row: [h & (1 << 64) - 1 for h in row[2] or ()]

    names = kept.columns
    at = [names.index(x) for x in ("__host", "__html", "__t") if x in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns) if i not in at]
            texts = [main_text(row[1], template_of(row)) for row in zip(*(batch.column(i).to_pylist() for i in at))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], schema.names)

    return kept.mapInArrow(run, schema)


def _own_hashes(rows: DataFrame) -> DataFrame:
    schema = T.StructType([rows.schema["__host"], rows.schema["__d"], T.StructField("h", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(host, d, _signed(h)) for host, page, d in zip(*(c.to_pylist() for c in batch.columns)) for h in page_hashes(page)[0]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], schema.names)

    return rows.mapInArrow(run, schema).distinct()


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
