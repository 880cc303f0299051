"""Main text of web pages by site style trees (operator 10).

Every page is read into blocks of text, each with its presentation: the path of tags (with their class) from
the body down. All pages of a host together form a style tree, whose nodes are those presentations. A node of
``MIN_PAGES`` pages or more is judged by what its pages show there. The presentation importance of a node is
the entropy of its pages' child sequences, to the base of its pages; the content importance of a block is one
minus the entropy of its text over the node's pages, so a text on every page has 0 and one seen once has 1.
A node's importance is the mean content importance of its blocks, raised to its presentation's where that is
higher. Pages of a host that say the same in what HTML leaves of them count once, so that copied articles do
not look like a template. Blocks of an importance under ``LEAST`` are removed from each page.

The entropies need pages to compare, and many menus and adverts vary from page to page. So what HTML itself
says about a branch is part of its importance: elements for navigation, forms, code and page frames have
none, nor have those whose class, id or role names an advert, menu, notice, sidebar or comment (inside an article
not the names of ``TEXT`` elements nor the ids of sections and anchors, which are often made of titles); nor has what stands
outside the page's article or main element where there is one. Every other block is judged by its
node. For plain prose right inside an article (elements without class, id or role) ``PROSE_HINT`` is added to the
log-odds of the node's importance: it goes only if its node says nearly the same on all pages.

Blocks have character references decoded and white space made one space; they are joined by line feeds.
Null and empty pages give an empty text; broken markup is read as far as it goes; long pages are read whole;
pages with one id or url are pages of their own; pages without a url form no site, so only HTML speaks for
them. An empty table gives an empty one. Columns not in ``keep`` are
ignored; names with ``_ex_`` are the operator's.
"""

from __future__ import annotations

import html as entities
import re
from hashlib import blake2b

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch.llm.common import per_text, table

MIN_PAGES, LEAST = 8, 0.3
#: Log-odds that being plain prose of an article adds to a node's importance; with LEAST its node may have 0.055 then.
PROSE_HINT = 2.0
# names of HTML elements and attribute words, by meaning
DROPPED = {"script", "style", "noscript", "template", "iframe", "svg", "annotation", "annotation-xml", "canvas", "object", "head", "title", "nav", "footer", "aside",
           "form", "button", "select", "textarea", "dialog", "menu", "input", "option", "label", "fieldset", "datalist", "audio", "video", "applet", "embed"}
#: RAW elements that are paired first: without an end tag of its own only the tag goes, not what follows.
PAIRED = {"svg", "noscript", "iframe", "template"}
#: Elements that hold an article's own text, whatever they are named there.
TEXT = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dt", "dd", "blockquote", "pre", "tr", "td", "th", "caption", "figcaption", "b", "i", "em", "strong"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption",
         "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
         "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSES_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|"
                   r"menu|nav\w*|breadcrumbs?|pagination|pager|sidebar|side-?bar|aside|widget|related|recommend\w*|share|sharing|social|toolbar|footer|"
                   r"comments?|respond|replies|disqus|masthead|site-?header|page-?header|skip-?link|search|tags?|navigation|contentinfo|complementary)(?=$|[\s_-])", re.I)
MAIN = ("article", "main")
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "table", "tbody", "thead", "tr", "td", "th", "caption",
         "figure", "figcaption", "section", "div", "header", "b", "i", "em", "strong", "u", "s", "small", "span", "a", "code", "sub", "sup", "q", "cite", "mark",
         "abbr", "time", "kbd", "samp", "var", "font", "center", "del", "ins", "tt", "big",
         "math", "semantics", "mrow", "mi", "mo", "mn", "ms", "mtext", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "munder", "mover", "munderover",
         "mtable", "mtr", "mtd", "mstyle", "mpadded", "menclose"}
#: Comments, declarations, then tags; quotes count after an equals sign only, as in browsers.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                 r"|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
PAIRS = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)>", re.I) for tag in PAIRED}
BLANK = re.compile(r"\s+")


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(source)} if "=" in source else {}


def pairs(source: str, tag: str) -> dict[int, int]:
    """Where the elements of this name that have an end tag begin and end."""
    found, begun = {}, []
    for m in PAIRS[tag].finditer(source):
        if not m[1]:
            if not m[2].endswith("/") or tag != "svg":  # only svg can be closed by its own tag
                begun.append(m.start())
        elif begun:
            found[begun.pop()] = m.end()
    return found


class Page:
    """A page's blocks in order: (path, text, dropped by its elements, inside an article, plain prose of an article)."""

    def __init__(self, source: str | None):
        self.blocks: list[tuple[str, str, bool, bool, bool]] = []
        #: by path, the sequence of the children's presentations, for the presentation entropy
        self.children: dict[str, list[str]] = {}
        self.stack = [("", "", False, False, False)]  # tag, path, dropped, inside, plain
        self.text: list[str] = []
        self.open: tuple | None = None
        if source:
            self.read(source)
        self.flush()

    def flush(self) -> None:
        if self.text:
            text = BLANK.sub(" ", entities.unescape("".join(self.text))).strip()
            if text:
                self.blocks.append((self.open[1], text, *self.open[2:]))
            self.text.clear()
        self.open = None

    def add(self, data: str) -> None:
        dropped = self.stack[-1][2]
        if self.open is not None and dropped != self.open[2]:
            if dropped:  # inside a line that stays
                return
            self.flush()
        if self.open is None:
            if data.isspace():
                return
            self.open = self.stack[-1]
        self.text.append(data)

    def push(self, tag: str, source: str) -> None:
        _, path, dropped, inside, plain = self.stack[-1]
        found = attributes(source)
        names = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}"
        own = tag in DROPPED or (tag == "header" and not inside) or "hidden" in found or found.get("aria-hidden") == "true"
        if not own and tag not in ("html", "body", *MAIN) and names.strip():
            if not inside:
                own = bool(NAMED.search(names))
            elif tag not in TEXT:
                own = bool(NAMED.search(f"{found.get('class', '')} {found.get('role', '')}" if tag in ("section", "a") else names))
        step = tag if not found.get("class") else f"{tag}.{'.'.join(sorted(found['class'].lower().split()))}"
        self.children.setdefault(path, []).append(step)
        plain = tag in MAIN or (plain and tag in PROSE and not names.strip())
        self.stack.append((tag, f"{path}/{step}", dropped or own, inside or tag in MAIN, plain))

    def close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if tag == "p" and self.stack[i][0] in BLOCK:
                return

    def read(self, source: str) -> None:
        at, ends = 0, {}
        while at < len(source):
            m = TAG.search(source, at)
            if not m:
                self.add(source[at:])
                return
            if m.start() > at:
                self.add(source[at:m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag in BLOCK:
                self.flush()
            if m[1]:
                self.close(tag)
                continue
            if tag in CLOSES_P:
                self.close("p")
            if tag in ("li", "tr", "td", "th", "dd", "dt", "option") and self.stack[-1][0] == tag:
                self.stack.pop()
            if tag in VOID:
                continue
            if tag in PAIRED:
                if tag not in ends:
                    ends[tag] = pairs(source, tag)
                at = ends[tag].get(m.start(), at)
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if not m[3].endswith("/") or tag in BLOCK:
                self.push(tag, m[3])


def left_by_html(page: Page) -> list[tuple[str, str, bool]]:
    """(path, text, plain prose of an article) of the blocks that HTML itself leaves: those in an article if there are any."""
    left = [(path, text, inside, plain) for path, text, dropped, inside, plain in page.blocks if not dropped]
    return [(p, t, plain) for p, t, inside, plain in left if inside] or [(p, t, plain) for p, t, _, plain in left]


def number(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def node_of(path: str) -> int:
    """A node of a style tree: the path without numbers, which often differ from page to page."""
    return number(re.sub(r"\d+", "0", path))


def tree_rows(page: Page) -> tuple[list[dict], list[dict], int]:
    """A page's part of its site's style tree, the nodes whose importance the page has to know, and a number of what it says."""
    rows = {(node_of(path), False, number(" ".join(steps))) for path, steps in page.children.items()}
    rows |= {(node_of(path), True, number(text)) for path, text, *_ in page.blocks}
    shaped = {node for node, content, _ in rows if not content}
    rows |= {(node, False, 0) for node, content, _ in list(rows) if node not in shaped}  # leaves have no children
    left = left_by_html(page)
    return ([{"node": n, "content": c, "value": v} for n, c, v in sorted(rows)],
            [{"node": n, "plain": p} for n, p in sorted({(node_of(path), plain) for path, _, plain in left})],
            number("\n".join(text for _, text, _ in left)))


ASKS = T.ArrayType(T.StructType([T.StructField("node", T.LongType()), T.StructField("plain", T.BooleanType())]))
ROWS = T.ArrayType(T.StructType([T.StructField("node", T.LongType()), T.StructField("content", T.BooleanType()), T.StructField("value", T.LongType())]))
BLOCKS = T.ArrayType(T.StructType([T.StructField("node", T.LongType()), T.StructField("plain", T.BooleanType()), T.StructField("text", T.StringType())]))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def style_trees(rows: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """_ex_host, node, importance of the nodes that enough pages have; ``rows`` has _ex_host, _ex_key, _ex_said and _ex_rows."""
    once = rows.where("_ex_host is not null").groupBy("_ex_host", "_ex_said").agg(F.min_by("_ex_rows", "_ex_key").alias("_ex_rows"))
    flat = once.select("_ex_host", F.inline("_ex_rows"))
    counted = flat.groupBy("_ex_host", "node", "content", "value").agg(F.count("*").alias("c"))
    only = lambda what: F.coalesce(F.sum(F.when(what, F.col("c"))), F.lit(0))
    nodes = counted.groupBy("_ex_host", "node").agg(
        only(~F.col("content")).alias("pages"), only(F.col("content")).alias("blocks"),
        F.coalesce(F.sum(F.when(~F.col("content"), F.col("c") * F.ln("c"))), F.lit(0.0)).alias("shapes"),
        F.coalesce(F.sum(F.when(F.col("content"), F.col("c") * F.ln("c"))), F.lit(0.0)).alias("texts")).where(F.col("pages") >= min_pages)
    presentation = 1 - F.col("shapes") / (F.col("pages") * F.ln("pages"))
    content = F.when(F.col("blocks") > 0, 1 - F.col("texts") / (F.col("blocks") * F.ln("pages"))).otherwise(F.lit(0.0))
    return nodes.select("_ex_host", "node", F.greatest(presentation, content).alias("importance"))


def weighed(importance: Column, plain: Column) -> Column:
    """A node's importance with what HTML says about the block."""
    sure = F.least(F.greatest(importance, F.lit(0.01)), F.lit(0.99))
    return F.when(plain, 1 / (1 + F.exp(-F.ln(sure / (1 - sure)) - PROSE_HINT))).otherwise(importance)


def extract(pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ("page_id", "url"),
            least: float = LEAST, min_pages: int = MIN_PAGES) -> DataFrame:
    """``keep`` + _ex_text."""
    marked = pages.withColumns({"_ex_key": F.xxhash64(F.col(f"`{url}`"), F.col(f"`{html}`")), "_ex_host": host_of(F.col(f"`{url}`"))})

    def parse_rows(sources):
        found = [tree_rows(Page(x)) for x in sources]
        return [list(column) for column in zip(*found, strict=True)] if found else [[], [], []]

    def parse_blocks(sources):
        return [[[{"node": node_of(path), "plain": plain, "text": text} for path, text, plain in left_by_html(Page(x))] for x in sources]]

    rows = table(per_text(marked.select("_ex_key", "_ex_host", html), html, [
        T.StructField("_ex_rows", ROWS), T.StructField("_ex_asks", ASKS), T.StructField("_ex_said", T.LongType())], parse_rows, ["_ex_key", "_ex_host"]), "ex_rows")
    low = table(style_trees(rows, min_pages).where(F.col("importance") < least), "ex_low")  # hints only raise an importance
    asked = rows.select("_ex_key", "_ex_host", F.inline("_ex_asks")).join(low, ["_ex_host", "node"]).where(weighed(F.col("importance"), F.col("plain")) < least)
    drops = table(asked.groupBy(F.col("_ex_key").alias("_ex_of")).agg(F.collect_set(F.struct("node", "plain")).alias("_ex_drops")), "ex_drops")
    blocks = per_text(marked, html, [T.StructField("_ex_blocks", BLOCKS)], parse_blocks, [*keep, "_ex_key"])
    gone = lambda b: F.coalesce(F.array_contains("_ex_drops", F.struct(b["node"].alias("node"), b["plain"].alias("plain"))), F.lit(False))
    text = F.array_join(F.transform(F.filter("_ex_blocks", lambda b: ~gone(b)), lambda b: b["text"]), "\n")
    joined = blocks.join(drops, F.col("_ex_key") == F.col("_ex_of"), "left")
    return joined.withColumn("_ex_text", text).drop("_ex_key", "_ex_of", "_ex_drops", "_ex_blocks")
