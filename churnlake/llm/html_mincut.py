"""Main-text extraction from HTML by minimum-cut block labelling.

A page is cut into text blocks at block-level elements. A logistic
classifier on a block's surroundings and text gives the cost of calling it
content or boilerplate: these are the capacities to the source and the sink.
Neighbouring blocks, and blocks that are close in the element tree, are tied
by smoothness edges. The maximum flow separates content from boilerplate.
The classifier starts from fixed weights and is adapted (maximum a posteriori)
on a bounded sample of blocks whose label their semantic container gives.
"""

from __future__ import annotations

import math
import re
from collections import deque
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.llm.common import hash_sample

# Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style title template noscript iframe svg math canvas textarea select datalist object "
                    "audio video".split())
RAW = frozenset("script style title textarea iframe noscript".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt "
                  "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
                  "nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td dd figcaption".split())
SECTIONS = frozenset("article aside body div footer form header main nav section html td table".split())
#: An opening tag closes these open elements, up to a section.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}

# Features, their element names and class, id or role words, and their weights before adaptation.
HINTS = {
    "navigation": ({"nav", "menu"}, "nav navbar navigation menu menubar topnav subnav toc sitemap", -7.0),
    "header": ({"header"}, "header masthead banner topbar logo branding", -5.0),
    "footer": ({"footer"}, "footer colophon copyright legal contentinfo", -7.0),
    "sidebar": ({"aside"}, "aside sidebar side rail complementary widget widgets", -7.0),
    "advert": ({"ins"}, "ad ads adv advert adverts advertisement sponsor sponsored promo promotion outbrain taboola "
                        "adsbygoogle adbox adslot affiliate", -8.0),
    "form": ({"form", "button", "fieldset", "label", "input", "search"},
             "form login signin signup search subscribe newsletter captcha", -7.0),
    "notice": ({"dialog"}, "notice cookie cookies consent gdpr popup modal overlay alert disclaimer paywall toast "
                           "notification dialog", -7.0),
    "comments": (set(), "comment comments commentlist disqus reply replies respond discussion reviews", -10.0),
    "other": (set(), "share sharing social related recommended recommendations breadcrumb breadcrumbs pagination "
                     "pager tags skip hidden byline-links print toolbar more trending popular", -5.0),
    "article": ({"article", "main"}, "article main", 4.0),
    "content": (set(), "content post entry story body text prose markdown", 2.0),
}
NAMES = list(HINTS)
TEXT_WEIGHTS = (0.0, 0.5, -2.0, 1.0, 0.5)  # bias, prose element, link share, words, sentence end
WORD_HINTS = {w: i for i, name in enumerate(NAMES) for w in HINTS[name][1].split()}
TAG_HINTS = {t: i for i, name in enumerate(NAMES) for t in HINTS[name][0]}
PRIOR = np.array(list(TEXT_WEIGHTS) + [HINTS[n][2] for n in NAMES])
HEADER, ARTICLE = NAMES.index("header"), NAMES.index("article")

NEXT_COST = 0.5  # smoothness between neighbours on the page
TREE_COST = 0.6  # and between blocks of one parent; halves with every level between

#: Open elements beyond this depth are not kept apart (their text is), as browsers do; so a step costs no more.
DEPTH = 512

_TAG = re.compile(r"</?[a-zA-Z]")
_HINT_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?",
                        re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block:
    __slots__ = ("text", "tag", "path", "hints", "links")

    def __init__(self, text, tag, path, hints, links):
        self.text, self.tag, self.path, self.hints, self.links = text, tag, path, hints, links


def _hints(tag: str, attrs: str) -> int:
    """Bit set of the hints of an element's own name, class, id and role."""
    bits = 1 << TAG_HINTS[tag] if tag in TAG_HINTS else 0
    if attrs and tag not in ("html", "body"):
        for m in _HINT_ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                bits |= 1 << NAMES.index("other")
            elif name != "aria-hidden":
                for w in _WORDS.findall(value):
                    if (i := WORD_HINTS.get(w.lower())) is not None:
                        bits |= 1 << i
    return bits


class _Tokens:
    """Tokens of a page: text, or (closing, name, attributes); reads every character a bounded number of times.

    A tag ends at the first ``>`` outside quotes. Whether there is one is the
    same for all places that lead to the same next quote or ``>``, so such
    places that lead nowhere are remembered, and the next one is looked for
    once.
    """

    def __init__(self, html: str):
        self.html, self.dead, self.cached = html, set(), {}
        self.last = {c: html.rfind(c) for c in "\"'>"}

    def _next(self, kind: re.Pattern, at: int) -> int:
        """First place from ``at`` on that ``kind`` matches, -1 if none."""
        lo, hi = self.cached.get(kind, (0, -2))
        if hi == -1 and at >= lo or lo <= at <= hi:
            return hi
        m = kind.search(self.html, at)
        self.cached[kind] = (at, m.start() if m else -1)
        return self.cached[kind][1]

    def _end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose attributes start at ``at``, -1 if none."""
        path = []
        while True:
            e = self._next(_MARK, at) if at <= max(self.last.values()) else -1
            if e >= 0 and self.html[e] == ">":
                return e
            if e < 0 or e in self.dead or e == self.last[self.html[e]]:
                self.dead.update(path, (e,))
                return -1
            path.append(e)
            at = self.html.find(self.html[e], e + 1) + 1

    def __iter__(self):
        html, at, size = self.html, 0, len(self.html)
        while at < size:
            if html[at] != "<":
                end = html.find("<", at)
                end = size if end < 0 else end
                yield None, html[at: end], None
                at = end
                continue
            end = -1
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                at = size if end < 0 else end + 3
                continue
            if html.startswith(("<!", "<?"), at):
                if at < self.last[">"]:
                    at = html.find(">", at) + 1
                    continue
            elif _TAG.match(html, at) and at < self.last[">"]:
                closing = html[at + 1] == "/"
                name = at + 1 + closing
                stop = self._next(_NAME_END, name)
                end = -1 if stop < 0 else self._end(stop)
                if end >= 0:
                    at = end + 1
                    skip = yield closing, html[name: stop].lower(), html[stop: end]
                    if skip:
                        yield
                        close = re.compile(rf"</{re.escape(skip)}", re.I).search(html, at)
                        at = close.start() if close else size
                    continue
            yield None, "<", None
            at += 1


_MARK, _NAME_END = re.compile("[\"'>]"), re.compile(r"[\s/>]")


def blocks_of(html: str) -> list[Block]:
    """Text blocks of a page in order; one pass, tolerant of unclosed elements."""
    out: list[Block] = []
    # name, hints with those of the ancestors, block level, nearest block's name, numbers of the nearest three blocks
    stack = [("#", 0, True, "#", (0,))]
    serial, skip_depth, links = 0, 0, 0
    parts: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                _, hints, _, name, path = stack[-1]
                out.append(Block(text, name, path, hints, min(1.0, linked / len(text))))
            parts.clear()
            linked = 0

    def pop_to(n):
        nonlocal links, skip_depth
        while len(stack) > n:
            if stack[-1][2]:
                flush()
            name = stack.pop()[0]
            links -= name == "a"
            skip_depth -= name in SKIPPED

    tokens = iter(_Tokens(html))
    for closing, tag, attrs in tokens:
        if closing is None:
            if not skip_depth:
                parts.append(tag)
                if links:
                    linked += len(tag)
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if stack[i][0] in SECTIONS and tag not in SECTIONS:
                    break  # a stray end tag does not close a section
            continue
        block = tag in BLOCK
        if block:
            for i in range(len(stack) - 1, 0, -1):
                name = stack[i][0]
                if name in CLOSES.get(tag, ()) or name == "p":
                    pop_to(i)
                    break
                if name in SECTIONS or name in ("ul", "ol", "dl", "menu", "tbody", "thead"):
                    break
            flush()
        if tag in VOID or attrs.rstrip().endswith("/") and tag in SKIPPED:
            if tag == "br" or block:
                parts.append(" ")
            continue
        serial += 1
        _, hints, _, name, path = stack[-1]
        own = _hints(tag, attrs)
        if own >> HEADER & 1 and hints >> ARTICLE & 1:
            own &= ~(1 << HEADER)  # the heading part of an article is content
        if len(stack) < DEPTH or tag in SKIPPED:
            stack.append((tag, hints | own, block, *((tag, (*path[-2:], serial)) if block else (name, path))))
            links += tag == "a"
            skip_depth += tag in SKIPPED
        if tag in RAW:
            tokens.send(tag)
    pop_to(1)
    flush()
    return out


def features(b: Block) -> list[float]:
    words = b.text.count(" ") + 1
    return [1.0, float(b.tag in PROSE), b.links, math.log1p(words) / 5,
            float(b.text[-1] in ".!?…\"'”»")] + [float(b.hints >> i & 1) for i in range(len(NAMES))]


def min_cut(content: list[float], boiler: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Blocks on the source side of a minimum cut (Dinic's blocking flows).

    ``content[i]`` is cut when block i is called boilerplate, ``boiler[i]``
    when it is called content, an edge when its ends differ. Where several
    cuts are minimal, the one with the most content is taken.
    """
    n = len(content)
    s, t = n, n + 1
    graph: list[list[list]] = [[] for _ in range(n + 2)]  # [to, capacity, reverse index]

    def tie(a, b, ab, ba):
        graph[a].append([b, ab, len(graph[b])])
        graph[b].append([a, ba, len(graph[a]) - 1])

    for i in range(n):  # the flow source - i - sink is taken at once
        d = content[i] - boiler[i]
        if d > 0:
            tie(s, i, d, 0.0)
        elif d < 0:
            tie(i, t, -d, 0.0)
    for a, b, w in edges:
        tie(a, b, w, w)
    eps = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for v, c, _ in graph[u]:
                if c > eps and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        if level[t] < 0:
            break
        nxt = [0] * (n + 2)
        path: list[list] = []
        u = s
        while True:  # depth first without recursion
            if u == t:
                f = min(e[1] for e in path)
                for e in path:
                    e[1] -= f
                    graph[e[0]][e[2]][1] += f
                path, u = [], s
                continue
            while nxt[u] < len(graph[u]):
                e = graph[u][nxt[u]]
                if e[1] > eps and level[e[0]] == level[u] + 1:
                    break
                nxt[u] += 1
            else:
                if u == s:
                    break
                level[u] = -1
                e = path.pop()
                u = graph[e[0]][e[2]][0]
                continue
            path.append(e)
            u = e[0]
    # what can't reach the sink is content
    reach = [False] * (n + 2)
    reach[t] = True
    queue = deque([t])
    while queue:
        u = queue.popleft()
        for v, _, r in graph[u]:
            if not reach[v] and graph[v][r][1] > eps:
                reach[v] = True
                queue.append(v)
    return [not reach[i] for i in range(n)]


def main_text(html: str, weights: np.ndarray) -> str:
    blocks = blocks_of(html)
    if not blocks:
        return ""
    z = np.array([features(b) for b in blocks]) @ weights
    content = np.logaddexp(0.0, z).tolist()  # -log P(boilerplate)
    boiler = np.logaddexp(0.0, -z).tolist()
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEXT_COST))
        for up in range(1, min(3, len(b.path))):  # the last block below the same parent, grandparent
            parent = b.path[-1 - up]
            if parent in last:
                edges.append((last[parent], i, TREE_COST / 2 ** (up - 1)))
            last[parent] = i
    keep = min_cut(content, boiler, edges)
    return "\n\n".join(b.text for b, k in zip(blocks, keep) if k)


SAMPLE_PAGES = 400  # pages whose blocks may adapt the weights
SAMPLE_BLOCKS = 200  # blocks of each


def _weak_rows(batches):
    """Features and label of blocks inside an article (1) or inside clear boilerplate elements (0)."""
    boiler = sum(1 << NAMES.index(n) for n in ("navigation", "footer", "sidebar", "advert", "form", "comments"))
    for b in batches:
        rows = []
        for h in b.column(0).to_pylist():
            for x in blocks_of(h or "")[:SAMPLE_BLOCKS]:
                if x.hints & boiler:
                    rows.append((features(x), 0))
                elif x.hints >> ARTICLE & 1:
                    rows.append((features(x), 1))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.float64())),
                                          pa.array([r[1] for r in rows], pa.int32())], ["x", "y"])


def adapt(rows: list[tuple[list[float], int]], strength: float = 0.02) -> np.ndarray:
    """Logistic weights with a Gaussian prior around PRIOR (Newton steps); PRIOR where there is nothing to learn."""
    w = PRIOR.copy()
    if not rows:
        return w
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    ridge = strength * len(y)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - PRIOR)
        w = w - np.linalg.solve(x.T * (p * (1 - p)) @ x + ridge * np.eye(len(w)), grad)
    return w


def _extracted(weights: np.ndarray):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = pa.array([main_text(h or "", weights) for h in part.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts,
                                                  pc.utf8_length(texts).cast(pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])
    return run


def extract_main_text(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row: the article's blocks in page order, joined by "\\n\\n".

    Defined results: null or empty html, or a page without text, gives an
    empty text; null ids and urls pass; repeated rows are extracted alike;
    among equal cuts the one with more content wins; extra columns are
    ignored; an empty table gives an empty result and learns nothing.
    """
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         F.col(html_col).cast("string").alias("html"))
    ids = [(r["page_id"],) for r in pages.where("page_id is not null").select("page_id").orderBy(
        F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES).collect()]
    rows = []
    if ids:
        wanted = F.broadcast(spark.createDataFrame(ids, "page_id long").distinct())
        sample = hash_sample(pages.join(wanted, "page_id", "left_semi").withColumn("all", F.lit(0)), "all",
                             ["page_id", "html"], SAMPLE_PAGES)
        rows = [(r["x"], r["y"]) for r in sample.select("html").mapInArrow(
            _weak_rows, "x array<double>, y int").collect()]
        rows.sort()
    return pages.mapInArrow(_extracted(adapt(rows)), "page_id long, url string, text string, n_chars long")
