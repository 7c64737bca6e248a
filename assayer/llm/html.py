"""Main text of web pages by minimum cut.

A page is read once, left to right, into blocks of text with their place in the
DOM. A linear classifier gives each block its log-odds of being content, from its
words and links and from the elements around it; they become the capacities to the
two terminals. Neighbours in the page, and neighbours under the same element, are
joined by smoothness edges. The minimum cut of that graph, found by maximum flow,
labels all blocks of the page at once.

No element settles what is in it: each element around a block adds to its log-odds,
for or against, and what the names of an element say weighs the less, the more of a
page's main part it holds (a form or a layout around a whole page, say). Blocks whose
own score is weak go with their neighbours.

Pages are independent of each other: one map over Arrow batches, no shuffle.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices

#: Elements whose whole content is not text of the page, forms' parts among them.
DROPPED = "script|style|noscript|template|svg|math|iframe|object|textarea|select|button|title|canvas|audio|video|datalist"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{DROPPED})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|style|aria-hidden|hidden|aria-label)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 dt dd pre address figcaption caption summary legend".split())
BLOCKS = LEAVES | frozenset(
    "html head body div section article main nav header footer aside form fieldset ul ol li dl menu table thead tbody tfoot tr td th "
    "blockquote figure details dialog center hr search hgroup label option optgroup".split()
)
HEADS = frozenset("h1 h2 h3".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
SPACED = frozenset("br td th img input wbr".split())
#: Elements and roles that are never part of an article.
NOT_CONTENT = frozenset("nav footer aside form dialog menu search label head".split())
NOT_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary dialog alertdialog search form menu menubar toolbar alert".split())
#: Words in class and id names that mark what is not content, and those that mark content.
NOT_CONTENT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription paywall sidebar sidenav rail widget widgets menu nav navbar navigation topbar breadcrumb breadcrumbs footer masthead "
    "comment comments commentlist disqus reply replies respond discussion feedback share sharing social related recommended recommendations trending teaser "
    "pagination pager login signup search form copyright legal disclaimer toolbar skip hidden offscreen".split()
)
CONTENT_NAMES = frozenset("article articlebody content post entry story main maincontent body text prose".split())
#: Words in names that say nothing by themselves.
PLAIN_NAMES = frozenset("list box block area wrap wrapper container inner outer section item items link links bar row col column group holder region panel module unit head body title js is".split())
#: Weights of the classifier (log-odds that a block is content): a tag or role that is never part of an article, names
#: against and for content, the main part, outside of it, links, words, the end of a sentence, an item of a list.
MARKED, AGAINST, FOR, IN_MAIN, OUTSIDE_MAIN = -6.0, -6.0, 0.8, 2.0, -1.5
LINKS, BIAS, PER_WORD, MOST_WORDS, SENTENCE, LISTED, HEADED = -3.0, -0.8, 0.1, 20, 0.8, -0.4, 0.4
#: Smoothness between neighbours under one element, between other neighbours, and between the next under one element.
SAME, NEXT, NEAR = 1.0, 0.3, 0.5


class _Element:
    """An element that is open: what it says by its tag (hard) and by its names (soft), and what it turns out to hold."""

    __slots__ = ("tag", "up", "hard", "soft", "names_for", "main", "mains", "words")

    def __init__(self, tag: str, up: _Element | None, hard: float = 0.0, soft: float = 0.0, names_for: int = 0, main: bool = False):
        self.tag, self.up, self.hard, self.soft, self.names_for, self.main = tag, up, hard, soft, names_for, main
        self.mains, self.words = 0, 0


def _names(value: str) -> tuple[float, int]:
    """How far the names of an element speak against content (0 to 1), and how many speak for it."""
    against, speak_for = 0.0, 0
    for name in value.split():
        if name.startswith(("has-", "with-", "no-", "has_", "with_", "no_")):
            continue
        words = [w for w in re.split(r"[-_:.0-9]+", name) if w]
        telling = [w for w in words if w not in PLAIN_NAMES]
        bad = sum(w in NOT_CONTENT_NAMES for w in words)
        if bad:
            against = max(against, bad / max(1, len(telling)))
        speak_for += any(w in CONTENT_NAMES for w in words)
    return min(1.0, against), speak_for


def _mark(tag: str, attrs: str, up: _Element) -> _Element:
    hard = soft = 0.0
    speak_for, role, main = 0, "", False
    if attrs and attrs.strip(" /"):
        for m in ATTRIBUTE.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id", "itemprop"):
                against, good = _names(value)
                soft, speak_for = min(soft, AGAINST * against), speak_for + good
                main |= "articlebody" in value.split()
            elif key == "role":
                role = value
            elif key == "hidden" or (key == "style" and "display:none" in value.replace(" ", "")) or (key == "aria-hidden" and value == "true"):
                hard = 2 * MARKED
    if tag in ("article", "main") or role in ("main", "article"):
        # such an element is a teaser or a comment only if its names say nothing else
        main, soft = True, soft if soft <= AGAINST else 0.0
    if tag in ("html", "body"):
        soft = 0.0
    if tag == "form" or role == "form":
        soft = min(soft, AGAINST)  # there are forms around whole pages
    elif tag in NOT_CONTENT or role in NOT_CONTENT_ROLES or (tag == "header" and not _within(up)):
        hard = min(hard, MARKED)
    return _Element(tag, up, hard, soft, speak_for, main and soft > AGAINST)


def _within(e: _Element | None) -> bool:
    while e is not None:
        if e.main:
            return True
        e = e.up
    return False


def blocks(page: str) -> list[tuple[str, float, int]]:
    """(text, log-odds of being content, number of its element) of each block, in page order."""
    out: list[tuple] = []
    stack = [_Element("", None)]
    numbers, counter = [0], 0
    parts: list[str] = []
    linked: list[str] = []
    in_link, at, has_main = 0, 0, False

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                top = stack[-1]
                share = len("".join(linked)) / max(1, len("".join(parts)))
                parent = numbers[-2] if top.tag in LEAVES and len(numbers) > 1 else numbers[-1]
                out.append((text, top, min(1.0, share), parent))
                top.words += text.count(" ") + 1
            parts.clear()
            linked.clear()

    def pop_to(size: int) -> None:
        for e in reversed(stack[size:]):
            e.up.words += e.words
            e.up.mains += e.mains + (e.main and not e.hard)
        del stack[size:]
        del numbers[size:]

    def push(e: _Element) -> None:
        nonlocal counter, has_main
        counter += 1
        stack.append(e)
        numbers.append(counter)
        has_main |= e.main and not e.hard

    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if in_link:
                linked.append(piece)
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m["raw"] and m["raw"].lower() != "title":
                parts.append(" ")
            continue
        tag, closing = tag.lower(), bool(m["end"] or m["end2"])
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag in SPACED:
            parts.append(" ")
            if tag not in BLOCKS:
                continue
        if tag not in BLOCKS:
            # inline: only what is marked as not content matters
            attrs = m["attrs"] or m["attrs2"] or ""
            if not closing and ("class" in attrs or "hidden" in attrs or "none" in attrs) and tag not in VOID and not attrs.endswith("/") and (e := _mark(tag, attrs, stack[-1])).hard + e.soft < AGAINST / 2:
                flush()
                push(e)
            elif closing and len(stack) > 1 and stack[-1].tag == tag:
                flush()
                pop_to(len(stack) - 1)
            continue
        if tag not in ("td", "th"):
            flush()
        if tag == "hr":
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    flush()
                    pop_to(i)
                    break
                if stack[i].tag in ("body", "html") and tag not in ("html",):
                    break
            in_link = 0
            continue
        while stack[-1].tag in LEAVES:
            pop_to(len(stack) - 1)
        if tag in ("li", "tr", "td", "th", "dt", "dd"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop_to(i)
                    break
                if stack[i].tag in ("ul", "ol", "menu", "table", "dl"):
                    break
        push(_mark(tag, m["attrs"] or m["attrs2"] or "", stack[-1]))
    if at < len(page):
        parts.append(page[at:])
        if in_link:
            linked.append(page[at:])
    flush()
    pop_to(1)
    total = stack[0].words
    evidence: dict[int, tuple[float, bool]] = {}

    def around(e: _Element) -> tuple[float, bool]:
        """What an element and those around it add to the log-odds, and whether one is the main part."""
        chain = []
        while e is not None and id(e) not in evidence:
            chain.append(e)
            e = e.up
        log_odds, main = evidence[id(e)] if e is not None else (0.0, False)
        for e in reversed(chain):
            names = e.soft
            if names and not main and (e.mains == stack[0].mains if has_main else e.words > 0.6 * total):
                names = 0.0  # what holds all of the page's main part is called so for another reason
            log_odds = max(-12.0, log_odds + e.hard + names + FOR * min(e.names_for, 2))
            main |= e.main
            evidence[id(e)] = log_odds, main
        return log_odds, main

    found = []
    for text, top, share, parent in out:
        log_odds, main = around(top)
        score = BIAS + PER_WORD * min(text.count(" ") + 1, MOST_WORDS) + LINKS * share + min(log_odds, 2 * FOR)
        score += SENTENCE * (text[-1] in ".!?…\"”»") + LISTED * (top.tag == "li") + HEADED * (top.tag in HEADS)
        score += IN_MAIN if main else OUTSIDE_MAIN if has_main else 0.0
        found.append((text, score, parent))
    return found


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the content side of a minimum cut (Dinic's maximum flow).

    A node with a positive score hangs on the source by that capacity, one with a
    negative score on the sink; edges are undirected.
    """
    n = len(scores)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    left: list[float] = []

    def add(a: int, b: int, forward: float, back: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        left.append(forward)
        heads[b].append(len(to))
        to.append(a)
        left.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            add(source, i, s, 0.0)
        elif s < 0:
            add(i, sink, -s, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if left[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(left[e] for e in path)
                for k, e in enumerate(path):
                    left[e] -= flow
                    left[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if left[e] <= 1e-12)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[a] < len(heads[a]):
                e = heads[a][at[a]]
                if left[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(heads[a]):
                path.append(heads[a][at[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break


def label(found: list[tuple[str, float, int]]) -> list[bool]:
    """Content or not, for each block."""
    scores = [s for _, s, _ in found]
    if not scores or min(scores) > 0:
        return [True] * len(scores)
    if max(scores) <= 0:
        return [False] * len(scores)
    edges, last = [], {}
    for i, (_, _, parent) in enumerate(found):
        if i:
            edges.append((i - 1, i, SAME if found[i - 1][2] == parent else NEXT))
            if last.get(parent, i - 1) != i - 1:
                edges.append((last[parent], i, NEAR))
        last[parent] = i
    return minimum_cut(scores, edges)


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(text for (text, _, _), content in zip(found, label(found), strict=True) if content)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every row's page: page_id, url, text, n_chars (code points of text).

    A null or empty page has an empty text; a very long one is read whole, in time that
    grows with its blocks. A block whose score is zero goes with its neighbours, and is
    no content without any. Null ids and urls stay null, repeated rows are repeated, an
    empty table gives no rows. Other columns of df are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                texts = [main_text(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    columns = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return columns.mapInArrow(run, "page_id long, url string, text string, n_chars long")
