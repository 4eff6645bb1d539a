"""HTML extraction with consensus host paths.

Each page's containers are scored by the text in their blocks; all that score vote with their generalised
tag-class path; votes are summed per host in Spark; every page is then extracted again, by the path
that its host agreed on, or by its own best container where it has no such path. A path is named by a
digest of its parent's name and its own step, so that a page of any depth takes memory by its elements.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_small, materialize, rows_of, table

#: Comments, sections, tags with whole attributes, declarations; then tags whose quotes don't close, to their first ">".
_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_TOKEN = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
#: Elements that are never part of an article.
DROPPED = frozenset("nav footer aside form button select option optgroup input dialog menu template svg canvas audio video head datalist".split())
#: Words of a class, id or role that mark what is beside the article.
BESIDE = frozenset(
    "nav navbar navigation menu menubar sidebar aside header footer masthead banner ad ads advert adverts advertisement advertising sponsor sponsored "
    "cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus reply replies respond breadcrumb breadcrumbs "
    "pagination pager newsletter signup login contentinfo complementary".split()
)
#: Words that mark it only where there is little prose: under PROSE characters outside links, or over a quarter in links.
DOUBTED = frozenset("promo promotion share sharing social related recommended subscribe subscription search widget toolbar skip copyright hidden".split())
PROSE = 200
REMARKS = frozenset("comment comments reply replies".split())
CONTENT = frozenset("article content post entry body text main story page".split())
#: A start tag closes open elements of these kinds (fixed by the HTML standard).
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
_SCOPE = frozenset("html body table td th button div section article main ul ol dl blockquote form fieldset".split())
#: What a start tag doesn't look beyond for what it closes: CLOSES by tag, and _SCOPE for all others.
_STOPS = {tag: tuple(sorted(_SCOPE - closes)) for tag, closes in CLOSES.items()}
_ALL_STOPS = tuple(sorted(_SCOPE))
_LEAF = frozenset("p pre li blockquote h1 h2 h3 h4 h5 h6 td th dt dd figcaption address".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: How many times the text at its host's path a page's own best container has to hold to stand; and if the two are apart, and it is prose of PROSE characters.
OUTWEIGH, OUTWEIGH_APART = 4.0, 2.0


class Element:
    __slots__ = ("tag", "parent", "key", "first", "last", "words", "gone", "holds", "beside", "in_header", "lift", "bonus", "score")

    def __init__(self, tag: str, parent: Element | None, attributes: str, first: int) -> None:
        classes, words, gone = "", set(), parent is not None and parent.gone or tag in DROPPED
        if attributes and not attributes.isspace():
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), a or b or c
                if name == "class":
                    classes = value
                if name in ("class", "id", "role"):
                    words.update(_TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                    gone = True
        self.tag, self.parent, self.first, self.last, self.score = tag, parent, first, -1, 0.0
        kinds = sorted({w for w in (re.sub(r"\d+", "", k) for k in classes.lower().split()) if w})
        step = ".".join([tag, *kinds]).encode("utf-8", "replace")
        self.key = hashlib.blake2b((parent.key if parent else b"") + step, digest_size=12).digest()
        self.words, self.gone, self.holds, self.beside, self.in_header, self.lift = words, gone, False, gone, False, None
        self.bonus = 1.5 if tag in ("article", "main") or "main" in words else 1.2 if words & CONTENT else 1.0

    @property
    def path(self) -> str:
        """The name of the tag-class path from the root to here; digits in classes don't count."""
        return self.key.hex()


class Block:
    __slots__ = ("element", "text", "linked", "kept")

    def __init__(self, element: Element, text: str, linked: int) -> None:
        self.element, self.text, self.linked, self.kept = element, text, min(linked, len(text)), False


class Stack:
    """Open elements, with the places of each kind, so that no tag has to look through all of them."""

    def __init__(self, root: Element) -> None:
        self.open, self._at = [root], {root.tag: [0]}

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these kinds, -1 if there is none."""
        return max((at[-1] for t in tags if (at := self._at.get(t))), default=-1)

    def push(self, element: Element) -> None:
        self._at.setdefault(element.tag, []).append(len(self.open))
        self.open.append(element)

    def pop_to(self, index: int, n_blocks: int) -> None:
        for element in self.open[index:]:
            element.last = n_blocks
            self._at[element.tag].pop()
        del self.open[index:]


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """Elements in page order, and blocks of text with their element; markup errors close what they must."""
    root = Element("#", None, "", 0)
    elements, blocks, stack = [root], [], Stack(root)
    parts: list[str] = []
    links = linked = 0
    owner = root

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            parts.clear()
            if text := " ".join(html.unescape(text).split() if "&" in text else text.split()):
                blocks.append(Block(owner, text, linked))
        linked = 0

    at, size = 0, len(page)
    while at < size:
        found = _MARKUP.search(page, at)
        begin = found.start() if found else size
        if begin > at:
            parts.append(page[at:begin])
            if links:
                linked += begin - at
        if not found:
            break
        at = found.end()
        closing, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if tag is None:
            if found.group().startswith("<![CDATA["):
                parts.append(html.escape(found.group()[9:-3]))
            continue
        tag = tag.lower()
        if not closing and tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if closing else 1))
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if closing:
            if (k := stack.last(tag)) > 0:
                stack.pop_to(k, len(blocks))
            owner = stack.open[-1]
            links = 0
            continue
        if tag in ("html", "body") and stack.last(tag) >= 0:
            continue
        closes = CLOSES.get(tag, ())
        while (k := stack.last("p", *closes)) > 0 and k > stack.last(*_STOPS.get(tag, _ALL_STOPS)):
            stack.pop_to(k, len(blocks))
            if stack.open[-1].tag not in closes and stack.open[-1].tag != "p":
                break
        if tag == "body" and (k := stack.last("head")) > 0:
            stack.pop_to(k, len(blocks))
        element = Element(tag, stack.open[-1], attributes, len(blocks))
        elements.append(element)
        if tag in VOID:
            element.last = len(blocks)
        else:
            stack.push(element)
        owner = stack.open[-1]
        links = 0
    flush()
    stack.pop_to(0, len(blocks))
    settle(elements, blocks)
    return elements, blocks


def settle(elements: list[Element], blocks: list[Block]) -> None:
    """Say which elements are beside the article, and which blocks are kept.

    What a class, id or role says is weighed against what the element holds: one that holds over half of
    the page's prose, and an article or a word for one, is a wrapper whatever else it is called.
    """
    counted = [0 if b.element.gone else len(b.text) for b in blocks]
    chars = [0, *accumulate(counted)]
    solid = [0, *accumulate(n - b.linked if n else 0 for n, b in zip(counted, blocks))]
    for e in elements:
        if e.tag in ("article", "main") and not e.gone and not e.words & REMARKS:
            up = e.parent
            while up is not None and not up.holds:
                up.holds, up = True, up.parent
    for e in elements:
        up = e.parent
        if up is None:
            continue
        prose, every = solid[e.last] - solid[e.first], chars[e.last] - chars[e.first]
        wraps = 2 * prose > solid[-1] and (e.holds or bool(e.words & CONTENT))
        root = e.tag in ("html", "body", "article", "main")
        heads = e.tag == "header" or "header" in e.words and not root and not wraps
        within = up.tag in ("article", "main") or up.in_header and not up.beside
        e.in_header = up.in_header or heads
        if e.tag == "article" and e.words & REMARKS:
            marked = not wraps
        elif root:
            marked = False
        else:
            marked = bool(e.words & BESIDE - {"header"}) and not wraps or bool(e.words & DOUBTED) and (prose < PROSE or 4 * prose < 3 * every)
        e.beside = up.beside or e.gone or marked or heads and not within
        e.lift = e if e.tag in ("article", "main") and not e.beside else up.lift
    for b in blocks:
        b.kept = not b.element.beside and (not b.element.in_header or b.element.tag in _HEADINGS)


def score(elements: list[Element], blocks: list[Block]) -> None:
    """Give containers the weight of the text in their blocks: all to the nearest one, half to the next."""
    for block in blocks:
        if not block.kept:
            continue
        solid = len(block.text) - block.linked
        weight = (1 + block.text.count(",") + min(solid / 100, 3)) * solid / len(block.text)
        near = block.element.parent if block.element.tag in _LEAF and block.element.parent else block.element
        near.score += weight * near.bonus
        if near.parent is not None:
            near.parent.score += weight * near.parent.bonus / 2


def votes(page: str | None) -> list[tuple[str, float]]:
    """Paths of all containers that score, with their share of the page's best score; one in an article or main votes for that."""
    if not page:
        return []
    elements, blocks = parse(page)
    score(elements, blocks)
    weights: dict[str, float] = {}
    for e in elements:
        if e.score > 0:
            path = (e.lift or e).path
            weights[path] = max(weights.get(path, 0.0), e.score)
    top = max(weights.values(), default=1.0)
    return [(path, weight / top) for path, weight in sorted(weights.items())]


def extract(page: str | None, path: str | None = None) -> str:
    """The main text of a page: blocks of the elements at `path`, or of its own best container."""
    if not page:
        return ""
    elements, blocks = parse(page)
    score(elements, blocks)
    best = max(elements, key=lambda e: e.score)
    own = best.lift or best
    chosen = [own]
    if path is not None and (agreed := [e for e in elements if e.path == path and not e.beside]):
        kept = [0, *accumulate(len(b.text) if b.kept else 0 for b in blocks)]
        inside = lambda e: kept[e.last] - kept[e.first]
        apart = all(e.last <= own.first or e.first >= own.last for e in agreed)
        done, theirs = 0, 0
        for e in agreed:
            theirs += kept[e.last] - kept[max(e.first, done)] if e.last > done else 0
            done = max(done, e.last)
        if inside(own) <= (OUTWEIGH_APART if apart and inside(own) >= PROSE else OUTWEIGH) * theirs + 1:
            chosen = agreed
    lines, done = [], 0
    for e in chosen:  # in page order; one inside another adds nothing
        lines += [b.text for b in blocks[max(e.first, done) : e.last] if b.kept]
        done = max(done, e.last)
    return "\n".join(lines)


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """host and path: the container path with most votes on each host (ties: the one of least name)."""
    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # weights are whole numbers, so that the sum of a host does not depend on its order
            sums: dict[tuple[str, str], int] = {}
            for host, page in rows_of(batch):
                for path, weight in votes(page):
                    sums[host, path] = sums.get((host, path), 0) + round(weight * 1000)
            columns = ([h for h, _ in sums], [p for _, p in sums], list(sums.values()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["host", "path", "weight"])

    cast = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    ballots = cast.mapInArrow(voted, "host string, path string, weight long")
    counted = ballots.groupBy("host", "path").agg(F.sum("weight").alias("total"))
    return counted.groupBy("host").agg(F.min_by("path", F.struct((-F.col("total")).alias("t"), F.col("path"))).alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages` (page_id, url, html).

    Null or empty html gives an empty text; a null url counts as a host of its own; a page of any length
    and depth takes time and memory by its length; repeated rows are extracted alike; of paths that a host
    votes for equally the one of least name counts, and of a page's containers of equal score the first;
    further columns are ignored, whatever their names; an empty table gives an empty result.
    """
    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page, path) for _, _, page, path in rows_of(batch)]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    agreed = materialize(host_paths(rows), "host-paths")
    hosted = attach_small(rows.withColumn("host", host_of(F.col("url"))), agreed, ["host"])
    return hosted.select("page_id", "url", "html", "path").mapInArrow(extracted, "page_id long, url string, text string, n_chars long")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
