"""Main text of web pages from flat text blocks.

A page is read once into a flat list of text blocks with their word counts, linked words and whether they stand
in a part of the page that is marked as something else (menu, footer, advert, comments ...).  A decision tree,
trained here on a small labelled table of blocks, sees a block together with its neighbours: word count and
link density of the previous, this and the next block.  Parsing is a per-row helper; neighbours, tree and
joining are column expressions over the page's array of blocks, so no block leaves its row and nothing is
shuffled.  The parser takes time and memory in proportion to the page, well-formed or not.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portvigil.llm.worker_cache import small

# Element names of the HTML standard, by the role they have here.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math meter nobr picture q "
    "rp rt ruby s samp small source span strike strong sub sup svg time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe object textarea select title head svg math".split())
APART = frozenset("nav footer aside form header button dialog menu fieldset".split())
MAIN = frozenset("article main".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
END_OPTIONAL = frozenset("p li dt dd tr td th option".split())
# Words of a class, id or role that mark a part as something else than the article.
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices alert popup modal overlay sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs "
    "header footer masthead topbar toolbar comment comments reply replies respond disqus discussion share sharing social "
    "related recommended recommendations newsletter subscribe subscription signup login search pagination pager copyright "
    "legal disclaimer complementary contentinfo dialog".split()
)

# Words that may stand beside those in one class, id or role without another meaning.
NEUTRAL_WORDS = frozenset(
    "area bar block body bottom box btn button buttons col column container content desktop fixed form global group icon "
    "icons inner item items js left link links list main mobile module outer panel posts primary right secondary section "
    "site slot sticky top unit wrap wrapper".split()
)

_DECLARATION = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
_TAG_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)


def _attributes(raw: str) -> dict[str, str]:
    """Values by lower-case name; of repeated names the first counts, one without a value is empty."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


def _is_apart(token: str) -> bool:
    """Whether a class, id or role, as a whole, names a part that is not the article: ``site-footer``, not ``has-sidebar``."""
    words = _WORD.findall(token)
    return any(w in APART_WORDS for w in words) and all(w in APART_WORDS or w in NEUTRAL_WORDS for w in words)


class _TagEnds:
    """Where the tags of a page end, found in linear time however many of them are never closed.

    Outside quotes, what follows from a quote sign does not depend on where the tag began, so a sign that led to a
    quote without end need not be followed again.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = {quote: page.rfind(quote) for quote in "\"'"}
        self.endless: set[int] = set()
        self.searched, self.found = 0, -1

    def _mark(self, at: int) -> int:
        """The next sign that matters to a tag from ``at`` on, or the page's length."""
        if not self.searched <= at <= self.found:
            found = _TAG_MARK.search(self.page, at)
            self.searched, self.found = at, found.start() if found else len(self.page)
        return self.found

    def of(self, at: int) -> int | None:
        """End of the tag whose name ends at ``at``: its ``>``, the page's length, or None within an endless quote."""
        page, followed = self.page, []
        here = self._mark(at)
        while here < len(page) and page[here] != ">":
            followed.append(here)
            if here in self.endless or here >= self.last[page[here]]:
                self.endless.update(followed)
                return None
            here = self._mark(page.find(page[here], here + 1) + 1)
        return here


def _next_tag(page: str, at: int, ends: _TagEnds) -> tuple[int, int, str | None, bool, str] | None:
    """(start, end, name, closing, attributes) of the first markup from ``at`` on; the name is None for a declaration."""
    at = page.find("<", at)
    while at >= 0:
        if declared := _DECLARATION.match(page, at):
            return at, declared.end(), None, False, ""
        if named := _NAME.match(page, at):
            end = ends.of(named.end())
            if end is not None:
                return at, min(end + 1, len(page)), named[2].lower(), bool(named[1]), page[named.end() : end]
        at = page.find("<", at + 1)
    return None


class _Mark:
    """A class mark on an element; one that is taken back has all those above it taken back, too."""

    def __init__(self, above: "_Mark | None") -> None:
        self.above = above
        self.holds = True


@dataclass
class _Open:
    """An open element; ``mark`` is the nearest class mark on it or above."""

    name: str
    apart: bool
    hidden: bool
    main: bool
    mark: _Mark | None = None


def _opened(name: str, raw: str, above: _Open) -> _Open:
    attributes = _attributes(raw) if raw else {}
    tokens = " ".join(attributes.get(k, "") for k in ("class", "id", "role")).lower().split()
    named = any(_is_apart(t) and not (above.main and t == "header") for t in tokens)
    mark = above.mark
    if name in MAIN and not above.main:
        around = None if named else mark
        while around is not None and around.holds:
            around.holds = False  # around an article nothing is apart by its class
            around = around.above
    elif named and name not in ("html", "body"):
        mark = _Mark(mark)
    apart = above.apart or name in APART and not (name == "header" and above.main)
    unseen = (
        attributes.get("hidden", "until-found").strip().lower() != "until-found"
        or attributes.get("aria-hidden", "").strip().lower() == "true"
        or bool(_NOT_SHOWN.search(attributes.get("style", "")))
    )
    return _Open(name, apart, above.hidden or name in HIDDEN or unseen, above.main or name in MAIN, mark)


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, words, linked words, apart, main) of each non-empty block, in page order."""
    found: list[tuple[str, int, int, _Open]] = []
    stack = [_Open("", False, False, False)]
    parts: list[str] = []
    linked = 0
    links = 0  # open <a> elements

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            words = text.count(" ") + 1
            found.append((text, words, min(words, linked), stack[-1]))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].hidden:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.split())

    at = 0
    opened = Counter()  # names on the stack
    ends = _TagEnds(page)
    while (tag := _next_tag(page, at, ends)) is not None:
        start, end, name, closing, attributes = tag
        add(page[at:start])
        at = end
        if name is None:
            continue
        if name == "a":
            links = max(0, links - 1) if closing else links + 1
        if name not in INLINE or name in HIDDEN:
            flush()
        if closing:
            while opened[name]:
                last = stack.pop().name
                opened[last] -= 1
                if last == name:
                    break
        elif name in RAW:
            raw_end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)  # raw text up to its end tag
            at = raw_end.end() if raw_end else len(page)
        elif name not in VOID and not attributes.endswith("/"):
            if name in END_OPTIONAL and stack[-1].name == name:
                opened[stack.pop().name] -= 1  # its end tag may be left out
            stack.append(_opened(name, attributes, stack[-1]))
            opened[name] += 1
    add(page[at:])
    flush()
    return [(*block, at.apart or at.mark is not None and at.mark.holds, at.main) for *block, at in found]


# A small labelled table of blocks, as (words, link density) of the previous, this and the next
# block, apart, main, and whether the block belongs to the article.
FEATURES = ("prev_words", "prev_links", "words", "links", "next_words", "next_links", "apart", "main")
LABELLED = (
    # an article in its own element: title, paragraphs of any length, with and without links, neighbours of all kinds
    (6, 0.0, 12, 0.0, 90, 0.0, 0, 1, 1), (12, 0.0, 90, 0.0, 60, 0.0, 0, 1, 1), (90, 0.0, 2, 0.0, 45, 0.0, 0, 1, 1),
    (45, 0.0, 1, 0.0, 9, 0.0, 0, 1, 1), (60, 0.1, 75, 0.2, 40, 0.0, 0, 1, 1), (40, 0.0, 30, 0.5, 8, 1.0, 0, 1, 1),
    (1, 1.0, 7, 0.0, 55, 0.0, 0, 1, 1), (55, 0.0, 120, 0.0, 6, 0.0, 0, 1, 1), (200, 0.0, 4, 0.0, 0, 0.0, 0, 1, 1),
    (0, 0.0, 3, 0.0, 0, 0.0, 0, 1, 1), (30, 0.0, 5, 1.0, 60, 0.0, 0, 1, 1), (9, 0.0, 3, 0.0, 5, 0.0, 0, 1, 1),
    (6, 1.0, 3, 0.0, 9, 0.0, 0, 1, 1), (4, 0.9, 1, 0.0, 0, 0.0, 0, 1, 1), (2, 0.4, 6, 0.0, 30, 0.5, 0, 1, 1),
    (30, 0.0, 5, 0.9, 3, 1.0, 0, 1, 1), (8, 1.0, 2, 1.0, 7, 0.0, 0, 1, 1), (0, 0.0, 4, 1.0, 20, 0.0, 0, 1, 1),
    # menus, footers, adverts, notices, forms, comments: marked as apart, whatever their size and place
    (0, 0.0, 1, 1.0, 1, 1.0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (1, 1.0, 8, 0.0, 12, 0.0, 1, 0, 0),
    (60, 0.0, 14, 0.0, 0, 0.0, 1, 0, 0), (90, 0.0, 40, 0.0, 50, 0.0, 1, 1, 0), (50, 0.0, 90, 0.0, 60, 0.0, 1, 1, 0),
    (8, 0.0, 25, 0.1, 30, 0.0, 1, 0, 0), (30, 0.0, 120, 0.0, 20, 0.0, 1, 0, 0), (45, 0.0, 3, 0.0, 6, 0.0, 1, 1, 0),
    (20, 0.0, 60, 0.0, 60, 0.0, 1, 0, 0), (12, 0.0, 2, 1.0, 70, 0.0, 1, 1, 0), (0, 0.0, 15, 0.0, 80, 0.0, 1, 0, 0),
    # no article element: text-heavy blocks with few links, and short ones between them
    (5, 0.0, 80, 0.0, 70, 0.0, 0, 0, 1), (70, 0.0, 60, 0.1, 40, 0.0, 0, 0, 1), (40, 0.0, 35, 0.0, 50, 0.0, 0, 0, 1),
    (60, 0.0, 6, 0.0, 45, 0.0, 0, 0, 1), (50, 0.0, 45, 0.2, 4, 1.0, 0, 0, 1), (4, 0.0, 30, 0.0, 25, 0.0, 0, 0, 1),
    (25, 0.0, 20, 0.0, 30, 0.1, 0, 0, 1), (3, 1.0, 40, 0.0, 60, 0.0, 0, 0, 1), (60, 0.0, 55, 0.0, 0, 0.0, 0, 0, 1),
    (2, 1.0, 65, 0.0, 0, 0.0, 0, 0, 1), (2, 1.0, 35, 0.1, 3, 1.0, 0, 0, 1), (0, 0.0, 50, 0.0, 0, 0.0, 0, 0, 1),
    # no article element: link lists and short blocks away from text
    (1, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0), (0, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0), (2, 1.0, 3, 0.0, 2, 1.0, 0, 0, 0),
    (4, 1.0, 20, 0.9, 3, 1.0, 0, 0, 0), (5, 0.5, 4, 0.0, 3, 1.0, 0, 0, 0), (60, 0.0, 5, 1.0, 4, 1.0, 0, 0, 0),
    (3, 1.0, 6, 0.0, 0, 0.0, 0, 0, 0), (50, 0.0, 30, 0.8, 2, 1.0, 0, 0, 0),
    (2, 1.0, 1, 1.0, 40, 0.0, 0, 0, 0), (3, 1.0, 4, 1.0, 60, 0.0, 0, 0, 0), (60, 0.0, 6, 1.0, 12, 0.9, 0, 0, 0),
    (80, 0.0, 9, 0.9, 20, 0.0, 0, 0, 0), (0, 0.0, 2, 1.0, 15, 0.1, 0, 0, 0), (70, 0.0, 3, 0.0, 50, 0.0, 0, 0, 1),
)


@dataclass
class Node:
    """A split (value of ``feature`` <= ``limit`` goes to ``low``), or a leaf with a ``label``."""

    label: int
    feature: int = -1
    limit: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None


def train_tree(rows: tuple = LABELLED, depth: int = 6) -> Node:
    """A classification tree by Gini impurity; ties go to the earlier feature and the smaller limit."""

    def gini(y: np.ndarray) -> float:
        p = y.mean() if len(y) else 0.0
        return len(y) * 2 * p * (1 - p)

    def grow(x: np.ndarray, y: np.ndarray, left: int) -> Node:
        node = Node(int(y.mean() >= 0.5))
        if left == 0 or y.min() == y.max():
            return node
        best = gini(y) - 1e-12
        for feature in range(x.shape[1]):
            values = np.unique(x[:, feature])
            for limit in (values[1:] + values[:-1]) / 2:
                low = x[:, feature] <= limit
                if (cost := gini(y[low]) + gini(y[~low])) < best - 1e-12:
                    best, node.feature, node.limit = cost, feature, float(limit)
        if node.feature >= 0:
            low = x[:, node.feature] <= node.limit
            node.low, node.high = grow(x[low], y[low], left - 1), grow(x[~low], y[~low], left - 1)
        return node

    table = np.array(rows, dtype=float)
    return grow(table[:, :-1], table[:, -1].astype(int), depth)


def as_column(node: Node, features: dict[str, Column]) -> Column:
    """The tree as a boolean expression."""
    if node.low is None or node.high is None:
        return F.lit(bool(node.label))
    test = features[FEATURES[node.feature]] <= node.limit
    return F.when(test, as_column(node.low, features)).otherwise(as_column(node.high, features))


def _features(all_blocks: Column, block: Column, at: Column) -> dict[str, Column]:
    def of(b: Column, name: str) -> dict[str, Column]:
        words = F.coalesce(b["words"], F.lit(0))
        return {f"{name}words": words, f"{name}links": F.when(words > 0, b["linked"] / words).otherwise(0.0)}

    before, after = F.get(all_blocks, at - 1), F.get(all_blocks, at + 1)
    flags = {"apart": block["apart"].cast("int"), "main": block["main"].cast("int")}
    return of(before, "prev_") | of(block, "") | of(after, "next_") | flags


def extract(df: DataFrame, tree: Node | None = None, keys: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The keys, text and n_chars (code points) of every page.

    White space inside a block becomes one space, character references are decoded, kept blocks are joined in
    page order by one line end.  A null or empty page, or one without article text, has the empty text; an empty
    table gives no rows; rows may repeat; other columns are not read.
    """
    kind = "array<struct<text:string,words:int,linked:int,apart:boolean,main:boolean>>"
    arrow_kind = pa.list_(
        pa.struct([("text", pa.string()), ("words", pa.int32()), ("linked", pa.int32()), ("apart", pa.bool_()), ("main", pa.bool_())])
    )
    names = ("text", "words", "linked", "apart", "main")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            parsed = [[dict(zip(names, b, strict=True)) for b in blocks(p or "")] for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(parsed, arrow_kind)], [*keys, "blocks"])

    rows = df.select(*keys, F.col(html_col).cast("string").alias("html"))
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    parsed = rows.mapInArrow(run, f"{schema}, blocks {kind}")
    model = tree or train_tree()
    all_blocks = F.col("blocks")
    kept = F.filter(all_blocks, lambda b, i: as_column(model, _features(all_blocks, b, i)))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return parsed.select(*keys, text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
