"""Main text of web pages by minimum-cut labelling.

A page becomes a chain of text blocks with the open elements above each.  A linear
classifier turns what a block looks like (elements and class names above it, share
of linked text, length, punctuation) into a cost of calling it content and a cost of
calling it boilerplate; these are the capacities to the two terminals.  Neighbouring
blocks, and blocks of one parent, are joined by edges whose capacity grows with
their nearness in the tree.  The minimum cut of that graph is the labelling with the
least total cost; it is found by maximum flow.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.DOTALL)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

RAW = frozenset("script style noscript template svg math iframe object audio video canvas textarea select title head".split())
#: Of these the text runs on to the end of the page if they are never closed.
RAW_TEXT = frozenset("script style noscript iframe textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start closes an open one of the same row.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
          "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
BLOCK_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol pre section table ul".split())

#: Weights of the classifier: positive for content.
ELEMENTS = {"article": 4.0, "main": 4.0, "nav": -14.0, "footer": -14.0, "aside": -14.0, "form": -14.0, "menu": -14.0,
            "button": -14.0, "dialog": -14.0, "fieldset": -8.0, "header": -7.0, "address": -3.0, "figcaption": -0.5}
AWAY = frozenset(
    "ad ads adv advert advertisement advertising adbox adslot sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login register "
    "sidebar side rail widget related recommended recommendations recommend more trending popular share sharing social follow "
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer foot masthead topbar toolbar comment "
    "comments commentlist reply replies respond disqus discussion copyright legal disclaimer skip search hidden "
    "complementary contentinfo teaser outbrain taboola form toc tags hide".split())
#: Names that say little as part of a longer one (overflow-hidden, more-space), and parts that make it a layout (has-sidebar).
ALONE = frozenset("hidden hide more side skip follow search legal popular share rail reply register".split())
LAYOUT = frozenset("has have no not non with without by is overflow".split())
TOWARDS = frozenset("article content post entry story main body text articlebody maincontent prose".split())
NAME_AWAY, NAME_TOWARDS, HIDDEN = -14.0, 2.5, -20.0
BIAS, LINKED, PER_WORD, MOST_WORDS, SENTENCE, MARK, HEADING = -0.6, -5.0, 0.12, 25, 0.8, -4.0, 0.8
NEXT, NEAR, SIBLING = 0.2, 0.8, 0.5
_MARK = re.compile(r"©|\(c\)\s*\d{4}|all rights reserved", re.IGNORECASE)


def _names(value: str) -> tuple[set[str], set[str]]:
    """(whole names, parts of longer names) of an attribute; layout names have no parts that count."""
    whole, parts = {name.lower() for name in value.split()}, set()
    for name in value.split():
        found = [p.lower() for p in _NAME_PART.findall(name)]
        if len(found) > 1 and not LAYOUT.intersection(found):
            parts.update(p for p in found if p not in ALONE)
        elif len(found) == 1:
            whole.update(found)
    return whole, parts


def _element_weight(tag: str, attributes: str, inside: float) -> float:
    """What an element adds to the score of all blocks below it."""
    weight = ELEMENTS.get(tag, 0.0)
    if tag == "header" and inside >= 4.0:
        weight = 0.0  # the head of the article, not of the site
    if attributes:
        named: list[tuple[set[str], set[str]]] = []
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("hidden", "aria-hidden"):
                weight += HIDDEN if value.lower() != "false" else 0.0
            elif name == "style":
                weight += HIDDEN if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else 0.0
            else:
                named.append(_names(value))
        aims = tag in ("article", "main") or any(whole & TOWARDS for whole, _ in named)
        for whole, parts in named:
            if (whole & AWAY or parts & AWAY and not aims) and tag not in ("body", "html"):
                weight += NAME_AWAY
            elif (whole | parts) & TOWARDS:
                weight += NAME_TOWARDS
    return weight


class Block:
    """A run of text no block element cuts."""

    __slots__ = ("text", "path", "score", "tag")

    def __init__(self, text: str, path: tuple[int, ...], score: float, tag: str):
        self.text, self.path, self.score, self.tag = text, path, score, tag


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in page order, with their classifier scores."""
    out: list[Block] = []
    stack: list[tuple[str, int, float]] = [("", 0, 0.0)]  # element, its number, score from here up
    parts: list[str] = []
    linked = count = 0
    number = 0
    in_link = 0

    def flush() -> None:
        nonlocal linked, count
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                words = text.count(" ") + 1
                tag = stack[-1][0]
                score = (BIAS + stack[-1][2] + LINKED * min(1.0, linked / max(1, count)) + PER_WORD * min(words, MOST_WORDS)
                         + (SENTENCE if text[-1] in ".!?…\"”»" else 0.0) + (MARK if _MARK.search(text) else 0.0)
                         + (HEADING if tag in ("h1", "h2", "h3") else 0.0))
                out.append(Block(text, tuple(e[1] for e in stack if e[0] not in ("p", "li")), score, tag))
            parts.clear()
        linked = count = 0

    def add(text: str) -> None:
        nonlocal linked, count
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            count += len(text)
            linked += len(text) if in_link else 0

    at, end = 0, len(page)
    while at < end:
        token = _TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        add(page[at:token.start()])
        at = token.end()
        close, tag, attributes = token.group(1, 2, 3) if token.group(2) else token.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not close and not attributes.endswith("/"):
                if tag == "head":
                    stop = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                    at = (stop.start() if stop and stop.group().lower().startswith("<body") else stop.end() if stop else at)
                else:
                    stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                    at = stop.end() if stop else end if tag in RAW_TEXT else at
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if close else 1
            continue
        flush()
        in_link = 0
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        shut = CLOSES.get(tag) or ({"p"} if tag in BLOCK_CLOSES_P else None)
        while shut and stack[-1][0] in shut:
            stack.pop()
        if tag not in VOID and not attributes.endswith("/"):
            number += 1
            inherited = stack[-1][2]
            stack.append((tag, number, inherited + _element_weight(tag, attributes, inherited)))
    flush()
    return out


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block with the next one, and with the last one of the same parent."""
    out = []
    last: dict[int, int] = {}
    for k, block in enumerate(blocks):
        if k:
            other = blocks[k - 1].path
            shared = 0
            for a, b in zip(other, block.path):
                if a != b:
                    break
                shared += 1
            out.append((k - 1, k, NEXT + NEAR * shared / max(len(other), len(block.path))))
        sibling = last.get(block.path[-1])
        if sibling is not None and sibling < k - 1:
            out.append((sibling, k, SIBLING))
        last[block.path[-1]] = k
    return out


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side (content) of the minimum cut; a positive score is capacity from the source, a negative one to the sink.

    The two terminal capacities of a node are log(1 + e^score) and log(1 + e^-score);
    what both have in common always flows, so only their difference, the score, is left.
    """
    n = len(scores)
    rest = list(scores)
    near: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, capacity in edges:
        near[a].append(len(to))
        to.append(b)
        room.append(capacity)
        near[b].append(len(to))
        to.append(a)
        room.append(capacity)
    tiny = 1e-9
    while True:
        came = [-2] * n
        queue = [k for k in range(n) if rest[k] > tiny]
        for k in queue:
            came[k] = -1
        goal = -1
        for k in queue:
            if rest[k] < -tiny:
                goal = k
                break
            for e in near[k]:
                if room[e] > tiny and came[to[e]] == -2:
                    came[to[e]] = e
                    queue.append(to[e])
        if goal < 0:
            return [c != -2 for c in came]
        k, flow = goal, -rest[goal]
        while came[k] >= 0:
            flow = min(flow, room[came[k]])
            k = to[came[k] ^ 1]
        flow = min(flow, rest[k])
        rest[k] -= flow
        rest[goal] += flow
        k = goal
        while came[k] >= 0:
            room[came[k]] -= flow
            room[came[k] ^ 1] += flow
            k = to[came[k] ^ 1]


def labelling_cost(scores: list[float], edges: list[tuple[int, int, float]], content: list[bool]) -> float:
    """Total cost of a labelling, as the cut counts it."""
    cost = sum(log1p(exp(-s)) if c else log1p(exp(s)) for s, c in zip(scores, content))
    return cost + sum(w for a, b, w in edges if content[a] != content[b])


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    content = minimum_cut([b.score for b in blocks], edges_of(blocks))
    return " ".join(b.text for b, keep in zip(blocks, content) if keep)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: page_id, url, text (blocks in page order, joined by one space) and n_chars.

    A null or empty page has an empty text, as has a page without content; broken and
    unclosed elements are read as far as they go; a very long page is one row of one
    task; repeated rows and null ids are rows of their own; other columns are not
    looked at.  Nothing is shuffled.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind, url = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return pages.mapInArrow(run, f"page_id {kind}, url {url}, text string, n_chars bigint")
