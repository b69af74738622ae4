"""HTML extraction by a site style tree.

Every page is a tree of block elements; a branch is a host with the path of tags
and classes from the root. The pages of a host merge into one style tree: each
branch counts the presentations (sequences of child elements) and the contents
(digests of all text below) that its pages show. The entropy of those counts,
over the largest that so many pages could have, is the branch's importance: what
looks and reads alike on every page tells nothing. Branches that HTML itself
names as menus, headers, footers, sidebars, notices, adverts, forms or comments
have importance 0 (inside an article by tag, role or a whole class or id only), and an article or main element itself has 1; what it holds is
measured like the rest, from a prior of 1 that weighs ``PRIOR_PAGES`` pages. Branches
of low importance are removed from each page; the blocks that stay, within the
article where a page has one, are joined in page order.

Counts are summed by branch and digest before they are shuffled, so a host of a
third of all pages is a few rows a task. The low branches reach the pages as one
sorted array of hashes if at most ``BROADCAST_BRANCHES``, and by a join beyond.

Defined cases: a null or empty page has no text; a null or odd url is a host of
its own name; a branch seen on fewer than ``MIN_PAGES`` pages has no evidence
against it; a page or article that would lose all text to entropy alone keeps it; equal rows
get equal texts; an empty table gives an empty result; other columns aren't read. A
page is parsed and measured in time that grows with its length, however deep it nests,
and held whole by the task that reads it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.shared import staged

MIN_PAGES = 5
PRIOR_PAGES = 2
LOW_IMPORTANCE = 0.2
CONTENT_WEIGHT = 0.7
BROADCAST_BRANCHES = 2_000_000
FLUSH_COUNTS = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br img".split())
NO_TEXT = frozenset("script style noscript template iframe object svg canvas video audio select option textarea button head title math datalist".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split()) | NO_TEXT
BOILERPLATE_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|cookies?|consent|gdpr|notices?|alert|menu|nav|navbar|navigation|breadcrumbs?|sidebar|footer|header|masthead|comments?|replies|disqus|share|sharing|social|related|recommended|newsletter|subscribe|popup|modal|login|signup|search|widget|toolbar|pagination|skip)(?:$|[-_ 0-9])"
)
#: Inside an article a name must be boilerplate as a whole; headings and their anchors are the author's.
WHOLE_NAMES = re.compile(
    r"(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|cookies?|consent|gdpr|notices?|alert|menu|nav|navbar|navigation|breadcrumbs?|sidebar|footer|comments?|replies|disqus|share|sharing|social|related|recommended|newsletter|subscribe|popup|modal|login|signup|search|widget|toolbar|pagination|skip)[-_]?[0-9]*"
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_NAMES = re.compile(r"(?:^|[-_ ])(?:article|post|entry|story)(?:[-_]?(?:body|content|text))?(?:$|[ ])")
#: Start tags that end an open element of the same group.
IMPLIED_END = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table body article section div td th".split())
_MASK, _ROLL = (1 << 64) - 1, 0x9E3779B97F4A7C15
NOISE, PLAIN, MAIN, ARTICLE = 0, 1, 2, 3  # MAIN is what an ARTICLE holds


class Element:
    """``first`` and ``last`` bound the text blocks in and below it; ``gone`` is set once it or one above is removed."""

    __slots__ = ("branch", "children", "first", "gone", "kind", "last", "parent", "tag")

    def __init__(self, tag: str, branch: int, kind: int, parent: Element | None, first: int = 0):
        self.tag, self.branch, self.kind, self.parent = tag, branch, kind, parent
        self.first, self.last, self.gone, self.children = first, None, False, []


class PageTree(HTMLParser):
    """Block elements of one page and its text blocks, in page order."""

    def __init__(self, host: str):
        super().__init__(convert_charrefs=True)
        self.top = self.root = Element("", xxhash.xxh3_64_intdigest(host), PLAIN, None)
        self.elements: list[Element] = [self.root]
        self.blocks: list[tuple[Element, str]] = []
        self.open: Counter = Counter()
        self._text: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in INLINE:
            if tag == "br":
                self._text.append(" ")
            return
        self._flush()
        if tag in VOID:
            return
        if self.top.tag == "p":
            self._pop()
        for name in IMPLIED_END.get(tag, ()):
            self._close(name, SCOPES if tag in ("li", "dt", "dd") else frozenset(("table",)))
        named = dict(attrs)
        names = " ".join(filter(None, (named.get("class"), named.get("id")))).lower()
        signature = f"{tag}.{re.sub(r'[0-9]+', '', names)}"
        self.open[tag] += 1
        branch = xxhash.xxh3_64_intdigest(signature, seed=self.top.branch)
        element = Element(tag, branch, self._kind(tag, names, (named.get("role") or "").lower(), (named.get("id") or "").lower()), self.top, len(self.blocks))
        self.top.children.append(xxhash.xxh3_64_intdigest(signature))
        self.elements.append(element)
        self.top = element

    def _kind(self, tag: str, names: str, role: str, anchor: str) -> int:
        above = self.top.kind
        if above == NOISE or tag in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES or (tag == "header" and above < MAIN):
            return NOISE
        if tag in ("html", "body"):
            return above
        if tag in MAIN_TAGS or role == "main":
            return ARTICLE
        if above >= MAIN:
            classes = names.removesuffix(anchor).split()
            own = [] if tag in HEADINGS else classes if tag == "section" else [*classes, anchor]
            return NOISE if any(WHOLE_NAMES.fullmatch(x) for x in own) else MAIN
        if names and BOILERPLATE_NAMES.search(names):
            return NOISE
        return ARTICLE if names and MAIN_NAMES.search(names) else above

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE and tag not in VOID:
            self._flush()
            self._close(tag, frozenset())

    def handle_data(self, data: str) -> None:
        self._text.append(data)

    def _pop(self) -> None:
        self.top.last = len(self.blocks)
        self.open[self.top.tag] -= 1
        self.top = self.top.parent

    def _close(self, tag: str, within: frozenset[str]) -> None:
        if not self.open[tag]:
            return
        at = self.top
        while at.parent is not None and at.tag != tag:
            if at.tag in within:
                return
            at = at.parent
        if at.parent is not None:
            while self.top is not at:
                self._pop()
            self._pop()

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            self._text.clear()
            if text:
                self.blocks.append((self.top, text))

    def finish(self) -> PageTree:
        self.close()
        self._flush()
        return self


def parse(host: str, html: str) -> PageTree:
    tree = PageTree(host)
    tree.feed(html)
    return tree.finish()


def features(tree: PageTree) -> Iterator[tuple[int, int, int, int]]:
    """(branch, content digest, presentation digest, kind) of the branches of a page.

    An element's blocks are neighbours, so a rolling hash over all blocks gives every digest in one step.
    """
    total, power = [0], [1]
    for _, text in tree.blocks:
        total.append((total[-1] * _ROLL + xxhash.xxh3_64_intdigest(text)) & _MASK)
        power.append(power[-1] * _ROLL & _MASK)
    merged: dict[int, list] = {}
    for e in tree.elements[1:]:
        found = merged.setdefault(e.branch, [0, 0, NOISE])
        looks = xxhash.xxh3_64_intdigest(repr([c for k, c in enumerate(e.children) if not k or e.children[k - 1] != c]))
        last = len(tree.blocks) if e.last is None else e.last
        content = (total[last] - total[e.first] * power[last - e.first]) & _MASK
        found[0], found[1] = (found[0] * 31 + content) & _MASK, (found[1] * 31 + looks) & _MASK
        found[2] = max(found[2], e.kind)
    for branch, (content, looks, kind) in merged.items():
        yield branch, content, looks, kind


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _count_features(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys, n = list(counts), list(counts.values())
        counts.clear()
        columns = list(zip(*keys, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array([_long(x) for x in columns[0]], pa.int64()), pa.array(columns[1], pa.int32()), pa.array([_long(x) for x in columns[2]], pa.int64()), pa.array(columns[3], pa.int32()), pa.array(n, pa.int64())], names=["branch", "aspect", "digest", "kind", "n"])

    for batch in rows:
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            for branch, content, looks, kind in features(parse(host, html)):
                counts[branch, 0, content, kind] += 1
                counts[branch, 1, looks, kind] += 1
            if len(counts) > FLUSH_COUNTS:
                yield flush()
    yield flush()


def importance(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(branch, pages, importance) of the merged style trees of all hosts."""
    counts = pages.select("host", "html").mapInArrow(_count_features, "branch long, aspect int, digest long, kind int, n long")
    by_digest = counts.groupBy("branch", "aspect", "digest").agg(F.sum("n").alias("n"), F.max("kind").alias("kind"))
    total = F.sum("n")
    entropy = F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total
    by_aspect = by_digest.groupBy("branch", "aspect").agg(total.alias("pages"), F.max("kind").alias("kind"), F.when(total > 1, entropy / F.log2(total)).otherwise(1.0).alias("entropy"))
    weighted = F.sum(F.col("entropy") * F.when(F.col("aspect") == 0, CONTENT_WEIGHT).otherwise(1 - CONTENT_WEIGHT))
    merged = by_aspect.groupBy("branch").agg(F.max("pages").alias("pages"), F.max("kind").alias("kind"), weighted.alias("measured"))
    with_prior = (F.col("measured") * F.col("pages") + PRIOR_PAGES) / (F.col("pages") + PRIOR_PAGES)
    fixed = F.when(F.col("kind") == NOISE, 0.0).when((F.col("kind") == ARTICLE) | (F.col("pages") < min_pages), 1.0).when(F.col("kind") == MAIN, with_prior).otherwise(F.col("measured"))
    return merged.select("branch", "pages", fixed.alias("importance"))


def main_text(tree: PageTree, is_low) -> str:
    """The text that stays once the low branches are gone."""
    branches = np.array([e.branch for e in tree.elements], dtype=np.uint64)
    # parents come before what they hold
    for element, low in zip(tree.elements[1:], is_low(branches)[1:].tolist(), strict=True):
        element.gone = element.parent.gone or (low and element.tag not in ("html", "body"))
    clean = [(e, t) for e, t in tree.blocks if e.kind != NOISE]
    own = [(e, t) for e, t in clean if e.kind >= MAIN] or clean
    return " ".join(t for _, t in [(e, t) for e, t in own if not e.gone] or own)


def _among(table: np.ndarray):
    def test(branches: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(branches), dtype=bool)
        return table[np.minimum(np.searchsorted(table, branches), len(table) - 1)] == branches

    return test


def _sorted(longs) -> np.ndarray:
    return np.sort(np.array(longs, dtype=np.int64).view(np.uint64))


def _extract(shared: Broadcast | None):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            own = [shared.value] * batch.num_rows if shared is not None else [_sorted(x or []) for x in batch.column("low").to_pylist()]
            texts = [main_text(parse(host, html), _among(low)) for host, html, low in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def _page_branches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        found = [[_long(b) for b in {e.branch for e in parse(h, x).elements}] for h, x in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(found, pa.list_(pa.int64()))], names=["page", "branches"])


def extract(pages: DataFrame, low_importance: float = LOW_IMPORTANCE, min_pages: int = MIN_PAGES, broadcast_branches: int = BROADCAST_BRANCHES) -> DataFrame:
    """(page_id, url, text) of every page."""
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    only = pages.select("page_id", "url", F.lower(F.when(host == "", F.coalesce("url", F.lit(""))).otherwise(host)).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    low = staged(importance(only, min_pages).filter(F.col("importance") < low_importance).select("branch"), "low-branches")
    schema = f"page_id {only.schema['page_id'].dataType.simpleString()}, url string, text string"
    if low.count() <= broadcast_branches:
        return only.mapInArrow(_extract(pages.sparkSession.sparkContext.broadcast(_sorted([r[0] for r in low.collect()]))), schema)
    keyed = only.withColumn("page", F.xxhash64("host", "html"))
    mine = keyed.select("page", "host", "html").mapInArrow(_page_branches, "page long, branches array<long>").select("page", F.explode("branches").alias("branch")).distinct()
    own = mine.join(low, "branch").groupBy("page").agg(F.collect_list("branch").alias("low"))
    return keyed.join(own, "page", "left").mapInArrow(_extract(None), schema)
