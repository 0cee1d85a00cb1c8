"""Main text of HTML pages by composite text density.

A page becomes a tree; each node has the characters and tags below it, and those of links. Its composite density is
characters a tag, adjusted for links against the page's own share of link text; its density sum adds up its children's
densities. The node with the largest sum is the core; the least density on the path from it to the body is the threshold.
The result is the core, widened to the article or main element that it stands in and joined by other articles that reach the threshold, or
else joined by those siblings of the path that reach it. Elements that by their tag, role, or class are no part of an article (menus, headers,
footers, sidebars, notices, adverts, forms, comments, scripts, styles) are left out before anything is counted; inside an
article or main element a class does so only on a container and only as a whole, and an id never. Formulas are text.

Pages are parsed whole where they are read, one at a time; nothing is shuffled.

Defined results: null or empty html, or html without text, gives an empty text; unclosed and stray tags are closed or
ignored as browsers do; equal sums go to the earlier node; repeated rows are extracted each; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.session import ship

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?:svg|math|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?/>"  # closes itself
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|svg|object|select|title)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?(?P<odd>[a-zA-Z][^\s/>]*)[^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))|([^\s=/\"']+)")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img br math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder "
    "mover munderover mmultiscripts mprescripts mtable mtr mtd mstyle mpadded mphantom menclose mspace semantics annotation "
    "annotation-xml".split()
)
OUT = frozenset(
    "nav footer aside form head button dialog menu audio video canvas input annotation annotation-xml mphantom".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|banner|nav|navbar|"
    r"navigation|menu|sidebar|side|rail|footer|breadcrumbs?|comments?|commentlist|disqus|replies|respond|cookies?|"
    r"consent|gdpr|notices?|alert|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|"
    r"recommendations|popup|modal|overlay|pagination|pager|widget|toolbar|masthead|copyright|legal|disclaimer|skip)"
    r"(?:$|[\s_-])",
    re.I,
)
#: Inside an article only these are left out by a class, and only if one of its names is of NAMES, all else of it being PARTS.
CONTAINERS = frozenset("div section ul ol dl table figure center".split())
PARTS = frozenset(
    "area articles bar block box buttons container content icons inner items links list outer panel posts section slot "
    "stories unit wrap wrapper".split()
)
HEADERS = re.compile(r"(?:^|[\s_-])(?:header|site-header|page-header|topbar)(?:$|[\s_-])", re.I)
KEPT_WHOLE = frozenset("html body article main".split())
#: Start tag: open elements that it closes, and where the search for them ends.
LIST_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
TABLE_ENDS = {
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
}
ENDS = LIST_ENDS | TABLE_ENDS
SCOPES = frozenset("html body div article section main td th table li blockquote figure button".split())


def _named_out(tag: str, name: str, value: str, inside_article: bool) -> bool:
    if not inside_article:
        return bool(NAMES.search(value) or HEADERS.search(value))
    if name == "id" or tag not in CONTAINERS:  # ids are made of headings there
        return False
    for token in value.split():
        own = [p for p in re.split("[_-]", token.lower()) if p and p not in PARTS]
        if own and all(map(NAMES.fullmatch, own)):
            return True
    return False


def _left_out(tag: str, attrs: str, inside_article: bool) -> bool:
    if tag in OUT or (tag == "header" and not inside_article):
        return True
    if not attrs or tag in KEPT_WHOLE:
        return False
    for m in ATTR.finditer(attrs):
        name = (m[1] or m[5]).lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and _named_out(tag, name, value, inside_article):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class _Page:
    """Nodes in page order with their counts, and the blocks of text with the node each stands in."""

    def __init__(self, html: str):
        self.tags, self.parent, self.end = ["#page"], [-1], [0]
        self.chars, self.links, self.n_tags, self.n_links = [0], [0], [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self.open = [0]
        self.articles = self.anchors = 0
        self.out = 0  # depth of the stack at which an element that is left out was opened
        self.parts: list[str] = []
        at = 0
        for m in TOKEN.finditer(html):
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            tag = m["tag"] or m["odd"]
            if tag:
                if m["close"] or m[0].startswith("</"):
                    self._close(tag.lower())
                else:
                    self._start(tag.lower(), m["attrs"] or "")
        if at < len(html):
            self._text(html[at:])
        while self.open:
            self._pop()

    def _text(self, raw: str) -> None:
        if not self.out:
            text = entities.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            n = len(text) - text.count(" ")
            self.chars[self.open[-1]] += n
            if self.anchors:
                self.links[self.open[-1]] += n

    def _flush(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                node = self.open[-1]
                while self.tags[node] in INLINE:
                    node = self.parent[node]
                self.blocks.append((node, text))
            self.parts = []

    def _pop(self) -> None:
        if self.tags[self.open[-1]] not in INLINE:
            self._flush()
        node = self.open.pop()
        self.end[node] = len(self.tags)
        tag = self.tags[node]
        self.articles -= tag in ("article", "main")
        self.anchors -= tag == "a"
        if self.out > len(self.open):
            self.out = 0
        if (up := self.parent[node]) >= 0:
            for counts in (self.chars, self.links, self.n_tags, self.n_links):
                counts[up] += counts[node]

    def _start(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag not in INLINE:
            self._flush()
        if tag in VOID:
            if not self.out:
                self.n_tags[self.open[-1]] += 1
            return
        if tag in ENDS:
            self._end_open(*ENDS[tag])
        elif tag not in INLINE:
            self._end_open({"p"}, SCOPES)
        left = not self.out and _left_out(tag, attrs, self.articles > 0)
        node = len(self.tags)
        self.tags.append(tag)
        self.parent.append(self.open[-1])
        self.end.append(0)
        here = not (self.out or left)
        self.chars.append(0)
        self.links.append(0)
        self.n_tags.append(int(here))
        self.n_links.append(int(here and tag == "a"))
        self.open.append(node)
        self.articles += tag in ("article", "main")
        self.anchors += tag == "a"
        if left:
            self.out = len(self.open)

    def _end_open(self, tags: set[str], scope: frozenset[str] | set[str]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[depth]]
            if tag in tags:
                while len(self.open) > depth:
                    self._pop()
                return
            if tag in scope:
                return

    def _close(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            held = self.tags[self.open[depth]]
            if held == tag:
                while len(self.open) > depth:
                    self._pop()
                return
            if tag in INLINE and held not in INLINE:
                return
        if tag == "p":
            self._flush()

    def density(self) -> list[float]:
        """Composite text density of every node; counts of 0 stand as 1, and the base of the logarithm never reaches 1."""
        body_share = self.links[0] / max(self.chars[0], 1)
        found = []
        for c, lc, t, lt in zip(self.chars, self.links, self.n_tags, self.n_links):
            if not c:
                found.append(0.0)
                continue
            t = max(t, 1)
            base = math.log(c / max(c - lc, 1) * lc + body_share * c + math.e)
            found.append(c / t * math.log1p(c / max(lc, 1) * t / max(lt, 1)) / math.log(base + math.e - 1))
        return found

    def text(self) -> str:
        density = self.density()
        total = [0.0] * len(density)
        for node in range(1, len(density)):
            total[self.parent[node]] += density[node]
        body = next((i for i, tag in enumerate(self.tags) if tag == "body"), 0)
        core = max(range(body, self.end[body]), key=lambda i: (total[i], density[i], -i))
        path = [core]
        while path[-1] != body:
            path.append(self.parent[path[-1]])
        threshold = min(density[i] for i in path)
        whole = [i for i in path if self.tags[i] in ("article", "main")]
        keep = [whole[-1]] if whole else [core]
        if whole:  # a page may hold several articles
            kept, end = whole[-1], 0
            for i in range(body + 1, self.end[body]):
                beside = self.tags[i] == "article" and i >= end and self.chars[i] and not (kept <= i < self.end[kept] or i < kept < self.end[i])
                if beside and density[i] >= threshold:
                    keep.append(i)
                    end = self.end[i]
        else:
            on_path = set(path)
            keep += [
                i for i in range(body + 1, self.end[body])
                if self.parent[i] in on_path and i not in on_path and not core <= i < self.end[core] and density[i] >= threshold
            ]
        inside = [(i, self.end[i]) for i in keep]
        return "\n\n".join(text for node, text in self.blocks if any(a <= node < b for a, b in inside))


def main_text(html: str | None) -> str:
    return _Page(html).text() if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(
        run, "page_id bigint, url string, text string, n_chars bigint"
    )


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
