"""Main text of web pages by minimum cut.

A page becomes a row of text blocks. A logistic classifier and the elements around a block give the costs of calling it
content or boilerplate, which are the capacities from the source and to the sink. Blocks that follow each other, and
blocks of one parent element, are joined by edges that grow with their closeness in the tree. The minimum cut is the
cheapest labelling; its content side is the main text. What elements say is a cost too: a name alone costs less than the
classifier and the edges can overrule, and a name that covers most of the page's words says nothing (``quiet_wrappers``).

The classifier reads only the shape of blocks (lengths, links, punctuation, place). It is fitted by Spark ML on blocks
of a bounded sample of pages whose semantic elements say what they are (``max_pages``); every page is labelled.
Extraction is narrow: one pass over the pages, one page in memory at a time.

* A null or empty page has an empty text, an empty table no rows. Repeated pages get equal texts; rows with null id or
  URL are kept. Other columns are carried, but for one named ``text``, which the result replaces.
* Whole pages are processed. An unclosed element ends where its parent ends.
* White space inside a block becomes one space; blocks are joined in page order by one space.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgrain.llm.maxflow import source_side
from shopgrain.session import materialize

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|iframe|title|textarea|select|object)\b[^>]*>.*?(?:</\1[^>]*>|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?][^>]*>",
    re.S | re.I,
)
# Elements that start a block, elements without content, elements that say what they hold.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
          "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ASIDE_TAGS = frozenset("nav footer header aside menu button dialog label".split())
WRAPPERS = frozenset("form fieldset".split())  # may hold a whole page, so no more than a name
MAIN_TAGS = frozenset("article main".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus discussion footer form gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification outbrain pager pagination popup promo promoted promotion recommended related replies "
    "reply respond share sharing sidebar signup social sponsor sponsored subscribe taboola toolbar widget".split()
)
MAIN_ROLES = frozenset("main article".split())
TALK_NAMES = frozenset("comment comments discussion disqus replies reply respond".split())  # may hold articles of readers
LAYOUT = frozenset("has no with without is not hide show".split())  # 'has-sidebar' tells of the page, not of the element
# What the open elements say, and the log odds of content it counts for.
NOTHING, MAIN, HINT, NAMED, TALK, FIXED, MAIN_IN_NAMED, MAIN_IN_TALK = range(8)
SAID = (0.0, 3.0, -1.0, -3.5, -3.5, -6.0, -1.0, -1.5)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
NAME = re.compile(r"[a-z]+")
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")

FEATURES = ("log_words", "link_share", "word_length", "stops", "capitals", "place", "log_neighbours")
FIRST_WEIGHTS = (0.9, -3.0, 0.0, 1.0, -1.0, 0.0, 0.3, -2.0)  # the last is the intercept; used without weak labels


@dataclass
class Block:
    path: tuple[int, ...]  # numbers of the open elements, outermost first
    said: int  # what the open elements say, one of NOTHING to MAIN_IN_TALK
    inside: tuple[tuple[int, int], ...] = ()  # numbers and kinds of the open elements that say something
    parts: list[str] = field(default_factory=list)
    text: str = ""
    n_words: int = 0
    n_linked: int = 0


def kind_of(tag: str, attributes: str) -> int:
    """What an element says by itself: whole names count, parts of longer names are a hint."""
    if tag in ASIDE_TAGS:
        return FIXED
    kind = NAMED if tag in WRAPPERS else NOTHING
    is_main = tag in MAIN_TAGS
    if attributes:
        for _, value in ATTRIBUTE.findall(attributes):
            for name in value.lower().strip("\"'").split():
                parts = NAME.findall(name)
                if not parts or parts[0] in LAYOUT:
                    continue
                if ASIDE_NAMES.isdisjoint(parts):
                    is_main |= not MAIN_ROLES.isdisjoint(parts)
                elif tag in ("body", "html"):
                    continue
                elif ASIDE_NAMES.issuperset(parts):
                    kind = TALK if kind == TALK or not TALK_NAMES.isdisjoint(parts) else NAMED
                elif kind == NOTHING:
                    kind = HINT
    return MAIN if is_main and kind in (NOTHING, HINT) else kind


def said_inside(outer: int, kind: int) -> int:
    """What is said of the content of an element of this kind: the nearest word, which an outer name weakens."""
    if outer == FIXED or kind == NOTHING:
        return outer
    if kind == HINT:
        return outer if outer in (NAMED, TALK) else HINT
    if kind == MAIN:
        return {NAMED: MAIN_IN_NAMED, MAIN_IN_NAMED: MAIN_IN_NAMED, TALK: MAIN_IN_TALK, MAIN_IN_TALK: MAIN_IN_TALK}.get(outer, MAIN)
    return TALK if kind == NAMED and outer in (TALK, MAIN_IN_TALK) else kind


def quiet_wrappers(blocks: list[Block]) -> None:
    """Take back what a name says if it covers most of the page's words and no main element stands outside of it.

    Whole pages are wrapped in forms, notices and the like; such a name tells nothing of the text.
    """
    words: dict[int, int] = {}
    main: dict[int, int] = {}
    all_words = all_main = 0
    for b in blocks:
        if b.said == FIXED:
            continue
        all_words += b.n_words
        all_main += b.said == MAIN
        for number, kind in b.inside:
            if kind == NAMED:
                words[number] = words.get(number, 0) + b.n_words
                main[number] = main.get(number, 0) + (b.said == MAIN)
    quiet = {number for number, n in words.items() if 2 * n > all_words and main[number] == all_main}
    for b in blocks if quiet else ():
        b.said = NOTHING
        for number, kind in b.inside:
            if number not in quiet:
                b.said = said_inside(b.said, kind)


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    blocks: list[Block] = []
    stack: list[tuple[str, int, int, int]] = []  # tag, number, what is said inside, kind
    links = number = 0
    block = Block((), NOTHING)

    def add(piece: str) -> None:
        if piece:
            piece = html.unescape(piece)
            block.parts.append(piece)
            if links:
                block.n_linked += len(piece.split())

    def close() -> None:
        nonlocal block
        words = "".join(block.parts).split()
        if words:
            block.text, block.n_words = " ".join(words), len(words)
            blocks.append(block)
        block = Block(
            tuple(n for t, n, _, _ in stack if t in BLOCKS), stack[-1][2] if stack else NOTHING,
            tuple((n, kind) for _, n, _, kind in stack if kind != NOTHING),
        )

    def pop_to(depth: int) -> None:
        nonlocal links
        for tag, *_ in stack[depth:]:
            links -= tag == "a"
        del stack[depth:]

    at = 0
    for m in TOKEN.finditer(page):
        add(page[at: m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            if m[1]:
                block.parts.append(" ")
            continue
        tag = tag.lower()
        if m[2]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is None:
                if tag in BLOCKS:
                    close()
            else:
                breaks = any(t in BLOCKS for t, *_ in stack[depth:])
                pop_to(depth)
                if breaks:
                    close()
            continue
        if tag in VOID:
            block.parts.append(" ")
            if tag == "hr":
                close()
            continue
        if tag in BLOCKS:
            ends = CLOSES.get(tag, {"p"})
            depth = len(stack)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    depth = i
                elif stack[i][0] in BLOCKS:
                    break
            pop_to(depth)
        number += 1
        outer, kind = stack[-1][2] if stack else NOTHING, kind_of(tag, m[4])
        if tag == "header" and outer in (MAIN, MAIN_IN_NAMED, MAIN_IN_TALK):
            kind = NOTHING  # the headline of the article itself
        stack.append((tag, number, said_inside(outer, kind), kind))
        links += tag == "a"
        if tag in BLOCKS:
            close()
    add(page[at:])
    close()
    quiet_wrappers(blocks)
    return blocks


def features_of(blocks: list[Block]) -> list[list[float]]:
    sizes = [b.n_words for b in blocks]
    out = []
    for i, b in enumerate(blocks):
        n, length = sizes[i], max(len(b.text), 1)
        near = max(sizes[i - 1] if i else 0, sizes[i + 1] if i + 1 < len(blocks) else 0)
        out.append([
            math.log1p(n), min(1.0, b.n_linked / max(n, 1)), length / max(n, 1) / 10,
            sum(map(b.text.count, ".!?")) / max(n, 1), len(CAPITALS.findall(b.text)) / length,
            i / len(blocks), math.log1p(near),
        ])
    return out


def logits(blocks: list[Block], weights: tuple[float, ...]) -> list[float]:
    """Log odds of content: the classifier's, within bounds, and what the open elements say."""
    out = []
    for b, x in zip(blocks, features_of(blocks)):
        shape = sum(w * v for w, v in zip(weights, x)) + weights[-1]
        out.append(max(-2.5, min(2.5, shape)) + SAID[b.said])
    return out


def edges_of(blocks: list[Block], strength: float = 0.8) -> list[tuple[int, int, float]]:
    """Between neighbours, and between a block and the last one of its parent; the closer in the tree, the stronger."""
    edges: dict[tuple[int, int], float] = {}
    last_of: dict[int, int] = {}
    for i, b in enumerate(blocks):
        parent = b.path[-2] if len(b.path) > 1 else 0
        for j in {i - 1, last_of.get(parent, -1)}:
            if j >= 0:
                other = blocks[j].path
                shared = 0
                for p, q in zip(b.path, other):
                    if p != q:
                        break
                    shared += 1
                edges[j, i] = strength * (shared + 1) / (max(len(b.path), len(other)) + 1)
        last_of[parent] = i
    return [(i, j, w) for (i, j), w in edges.items()]


def main_text(page: str | None, weights: tuple[float, ...] = FIRST_WEIGHTS) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    content = source_side(logits(blocks, weights), edges_of(blocks))
    return " ".join(b.text for b, inside in zip(blocks, content) if inside)


def fit_classifier(pages: DataFrame, html_column: str = "html", max_pages: int = 2_000) -> tuple[float, ...]:
    """Weights of a logistic regression on blocks of about ``max_pages`` pages, labelled by semantic elements."""
    n = pages.count()
    share = min(1.0, max_pages / max(n, 1))
    # By all columns, so that a page of many rows is not in whole or out whole.
    drawn = F.pmod(F.xxhash64(*pages.columns), F.lit(1_000_000))
    sample = pages.where(drawn < int(share * 1_000_000)).select(html_column)

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = [], []
            for page in batch[html_column]:
                blocks = blocks_of(page or "")
                for b, f in zip(blocks, features_of(blocks)):
                    if b.said in (MAIN, NAMED, TALK, FIXED):
                        x.append(f)
                        y.append(float(b.said == MAIN))
            yield pd.DataFrame({"x": pd.Series(x, dtype=object), "label": pd.Series(y, dtype=float)})

    rows = materialize(sample.mapInPandas(examples, "x array<double>, label double"), "examples")
    if {row["label"] for row in rows.select("label").distinct().collect()} != {0.0, 1.0}:
        return FIRST_WEIGHTS
    model = LogisticRegression(regParam=0.01, maxIter=30).fit(rows.select(array_to_vector("x").alias("features"), "label"))
    return (*map(float, model.coefficients), float(model.intercept))


def extract(pages: DataFrame, html_column: str = "html", weights: tuple[float, ...] | None = None) -> DataFrame:
    """The pages with ``text`` in place of the raw page."""
    weights = weights or fit_classifier(pages, html_column)

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(page, weights) for page in column], dtype=object)

    kept = [c for c in pages.columns if c not in (html_column, "text")]
    return pages.select(*kept, text_of(html_column).alias("text"))
