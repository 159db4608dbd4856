"""The main text of a web page by tag-path ratios.

Every text node has a path of tags from the root. Pages repeat a path for what belongs together, so length and punctuation are
summed for each path; the two ratios (text and marks of a node of the path) are smoothed over the page's order, multiplied, and the paths that
reach a share of the page's spread are content. The article is the element that holds them.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text is raw, that never hold an article's text, that hold nothing, that don't end a block.
RAW = "script|style|textarea|xmp|iframe|noembed|noframes|noscript|title"
NEVER = frozenset("head nav footer aside form button select option svg math template object canvas audio video dialog menu".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("html body div main article section center table tbody tr td".split())
#: What a start tag closes: elements that end when a like one, or a block, begins; the elements that keep outer ones open.
CLOSES = {t: frozenset(c.split()) for t, c in {"li": "li p", "dt": "dt dd p", "dd": "dt dd p", "tr": "tr td th p", "td": "td th p", "th": "td th p", "option": "option", "tbody": "tbody thead tr td th p"}.items()}
BLOCKS = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HOLDS = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "table tr", "th": "table tr", "tbody": "table", "option": "select"}
#: Words in class, id or role of what isn't the article.
NOT_ARTICLE = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share comment comments commentlist complementary consent contentinfo cookie cookies copyright disclaimer disqus dialog
    footer gdpr header login masthead menu modal navbar nav navigation newsletter notice notices notification overlay pagination pager paywall popup promo promoted promotion recommended related reply respond search
    share sharing shop sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets alert alertdialog""".split()
)
MARKS = re.compile(r"[.,;:!?…。，、；：！？]")
TOKEN = re.compile(rf"<!--(?:.*?--!?>|.*\Z)|<(?P<raw>{RAW})\b[^<>]*>(?:.*?</(?P=raw)\b[^<>]*>|.*\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)/?>|<[!?/][^<>]*>|(?P<text>[^<]+|<)", re.IGNORECASE | re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
#: Share of the spread of scores that a path must reach; weights of neighbours in the page's order; share of the content that the article's element must hold.
LEAST, KERNEL, HELD = 0.25, np.array([0.05, 0.25, 0.4, 0.25, 0.05]), 0.7


def _outside(tag: str, rest: str, inside_article: bool) -> bool:
    """Whether an element holds something else than the article."""
    if tag in NEVER or tag == "header" and not inside_article:
        return True
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)} if rest else {}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.IGNORECASE):
        return True
    if tag in ("html", "body", "main"):
        return False
    names = [n for k in ("class", "id", "role") for n in found.get(k, "").split()]
    if tag == "article" or inside_article and tag in INLINE:
        return any(n.lower() in ("comment", "comments") for n in names)
    for name in names:
        words = [w.lower() for w in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", name) if w]
        if words and words[0] not in ("has", "with", "no", "without") and not NOT_ARTICLE.isdisjoint(words):
            return True
    return False


class _Page:
    """Text nodes of a page in order, with their elements; an element has a number above its parent's, its tag and what it inherits."""

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.out, self.linked, self.article = ["#"], [-1], [False], [False], [False]
        self.path, self.paths = [0], {}  # the number of an element's tag path; the numbers of (path, tag)
        self.nodes: list[tuple[int, int, str]] = []  # element, block, text
        self.block, self.open, self.count = 0, [0], Counter()
        for m in TOKEN.finditer(source):
            if (text := m["text"]) is not None:
                self.nodes.append((self.open[-1], self.block, text))
            elif m["tag"]:
                tag = m["tag"].lower()
                if m["end"]:
                    self._close(tag)
                else:
                    self._start(tag, m["rest"])

    def _start(self, tag: str, rest: str) -> None:
        if tag in BLOCKS:
            self._end_open(frozenset({"p"}), "button td th table li")
        elif tag in CLOSES:
            self._end_open(CLOSES[tag], HOLDS[tag])
        if tag not in INLINE:
            self.block += 1
        elif tag == "br":
            self.nodes.append((self.open[-1], self.block, " "))
        if tag in EMPTY:
            return
        above = self.open[-1]
        self.tags.append(tag)
        self.parents.append(above)
        self.out.append(self.out[above] or _outside(tag, rest, self.article[above]))
        self.linked.append(self.linked[above] or tag == "a")
        self.article.append(self.article[above] or tag == "article")
        self.path.append(self.paths.setdefault((self.path[above], tag), len(self.paths) + 1))
        self.open.append(len(self.tags) - 1)
        self.count[tag] += 1

    def _cut(self, at: int) -> None:
        self.count.subtract(self.tags[e] for e in self.open[at:])
        del self.open[at:]

    def _end_open(self, ends: frozenset[str], held_by: str) -> None:
        """Close the outermost element that `ends` names, unless an element of held_by lies further in."""
        stop, holders = 0, held_by.split()
        if not any(self.count[t] for t in ends):
            return
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[at]]
            if tag in ends:
                stop = at
            elif tag in holders:
                break
        if stop:
            self._cut(stop)
            self.block += 1

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self.block += 1
        if not self.count[tag]:
            return
        for at in range(len(self.open) - 1, 0, -1):
            found = self.tags[self.open[at]]
            if found == tag:
                self._cut(at)
                return
            if tag in INLINE and found not in INLINE:  # the end of an inline element that a block has ended
                return


def content_paths(paths: list[int], lengths: np.ndarray, marks: np.ndarray) -> set[int]:
    """The paths whose fused, smoothed ratios reach LEAST of the spread; all if no path stands out."""
    number = {p: i for i, p in enumerate(dict.fromkeys(paths))}
    of = np.array([number[p] for p in paths])
    nodes = np.bincount(of)
    smooth = lambda ratio: np.convolve(np.pad(ratio[of], 2, mode="edge"), KERNEL, mode="valid")
    fused = smooth(np.bincount(of, lengths) / nodes) * smooth(1 + np.bincount(of, marks) / nodes)
    score = np.bincount(of, fused) / nodes
    least = LEAST * fused.std()
    return {p for p, i in number.items() if score[i] >= least}


def main_text(source: str) -> str:
    """The article of a page: blocks in order, joined by one space."""
    page = _Page(source)
    kept = [(e, b, t) for e, b, t in page.nodes if not page.out[e]]
    signs = [(e, t.strip()) for e, _, t in kept if not t.isspace()]
    if not signs:
        return ""
    own = [(0, 0) if page.linked[e] else (len(t), len(MARKS.findall(t))) for e, t in signs]
    chosen = content_paths([page.path[e] for e, _ in signs], *np.array(own, float).T)
    weight = [0] * len(page.tags)
    for e, t in signs:
        if page.path[e] in chosen:
            weight[e] += len(t)
    for e in range(len(weight) - 1, 0, -1):
        weight[page.parents[e]] += weight[e]
    article = _article(page, weight)
    inside = [False] * len(weight)
    for e in range(article, len(weight)):
        inside[e] = e == article or inside[page.parents[e]]
    blocks: dict[int, list[str]] = defaultdict(list)
    for e, b, t in kept:
        if inside[e]:
            blocks[b].append(t)
    told = (" ".join(html.unescape("".join(parts)).split()) for _, parts in sorted(blocks.items()))
    return " ".join(t for t in told if t)


def _article(page: _Page, weight: list[int]) -> int:
    """From the root down to the element that still holds HELD of the content; an article element ends the way."""
    at = 0
    for e in range(1, len(weight)):  # an element comes after its parent
        if page.parents[e] == at and page.tags[at] != "article" and page.tags[e] in CONTAINERS and weight[e] >= HELD * weight[0]:
            at = e
    return at


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(h or "") for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page: the article without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments.

    Rows with null or empty html, or without an article, have an empty text and 0 characters; repeated rows stay. Character references are decoded,
    white space inside a block becomes one space; a page of one block is that block. No rows give no rows.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
