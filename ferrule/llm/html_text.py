"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded as a tree.

Each node has features of its tag and attribute tokens, its subtree's density of
text, links and tags, its depth and its place among its siblings.  The trees are
trained here, in numpy, on nodes of a bounded sample of pages.  Labels don't come
from names of tags or attributes: what a page calls its title stands again as the
headline of its text, and the least element with that headline and more text is
the text (without a headline, the element whose paragraphs have most of it).  Of
what lies in it, parts that say they are something else are left out.  Decoding takes the most likely labelling in
which every path from the root goes from outside to inside the text and from
there at most once to something left out, so no choice contradicts an
ancestor's.

Results in odd cases: null and empty pages, and pages without text, give an
empty string; markup that is never closed ends with its parent, but for script
and style, which then reach to the end of the page; unknown tags are inline;
scripts, styles, noscript, templates, graphics, frames and form fields have no
text; without sample pages the semantic labels' rule itself decides; repeated
rows are extracted each; an empty table gives an empty result; other columns are
passed over.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pages, thinned

#: Pages and nodes learned from at most; rounds, depth and learning rate of the trees; bins of a feature.
SAMPLE_PAGES, SAMPLE_NODES = 600, 60_000
ROUNDS, DEPTH, RATE, BINS, LEAF = 40, 3, 0.3, 32, 20

# HTML's kinds of elements, and tokens that name parts of pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
#: Elements without text of the page; PLAIN ones of them hold no markup.  In FOREIGN ones a tag can close itself.
HIDDEN = frozenset("noscript template svg iframe textarea select".split())
PLAIN, FOREIGN = frozenset("iframe textarea".split()), frozenset("svg math".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table td th body html article section div main math object".split()) | HIDDEN
SAME_SCOPE = frozenset("ul ol dl table math object".split()) | HIDDEN
APART = frozenset("nav aside footer header form button dialog menu head title".split()) | RAW | HIDDEN
TEXTUAL = frozenset("article main".split())
NAMES_APART = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer header masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted recommended related reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
NAMES_TEXT = frozenset("article body content entry main post story text".split())

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
NAMED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++)""", re.I)
#: Attributes that end with a slash of the tag, not of an unquoted value.
CLOSED = re.compile(r"""(?:^|["'\s]|(?:^|["'\s])[^\s"'=]+)/\Z""")
WORD = re.compile(r"[a-z]+")


class Page:
    """Nodes in document order, and the text pieces with the node that each is in."""

    def __init__(self, html: str):
        self.tag, self.parent, self.names = ["#root"], [-1], [frozenset()]
        self.pieces: list[tuple[int, str | None]] = []
        self.hidden, self.foreign = [False], [False]
        stack, at, n = [0], 0, len(html)
        self.html = html
        for m in TOKEN.finditer(html):
            if m.start() < at:
                continue  # within raw text
            self._text(stack[-1], html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(stack, tag)
                continue
            if tag in CLOSES_P:
                self._end(stack, ("p",), SCOPE)
            if tag in SAME:
                self._end(stack, SAME[tag], SAME_SCOPE)
            node = self._open(stack[-1], tag, m[3])
            if self.foreign[node] and CLOSED.search(m[3]):
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*+>", re.I).search(html, at)
                at = end.end() if end else n
            elif tag in PLAIN and (end := re.compile(rf"<(/?){tag}\b[^>]*+>", re.I).search(html, at)) and end[1]:
                at = end.end()
            elif tag not in VOID:
                stack.append(node)
        self._text(stack[-1], html[at:])

    def _text(self, node: int, text: str) -> None:
        if text and not self.hidden[node]:
            self.pieces.append((node, text))

    def _open(self, parent: int, tag: str, attributes: str) -> int:
        found = NAMED.findall(attributes) if attributes else ()
        self.names.append(frozenset(w for x in found for w in WORD.findall(x.lower())) if found else frozenset())
        self.tag.append(tag)
        self.parent.append(parent)
        node = len(self.tag) - 1
        self.hidden.append(self.hidden[parent] or tag in HIDDEN)
        self.foreign.append(self.foreign[parent] or tag in FOREIGN)
        if (tag in BLOCK or tag == "br") and not self.hidden[node]:
            self.pieces.append((node, None))
        return node

    def _pop(self, stack: list[int], k: int) -> None:
        if any(self.tag[x] in BLOCK and not self.hidden[x] for x in stack[k:]):
            self.pieces.append((stack[k], None))
        del stack[k:]

    def _end(self, stack: list[int], tags: tuple[str, ...], scope: frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            own = self.tag[stack[k]]
            if own in tags:
                self._pop(stack, k)
                return
            if own in scope:
                return

    def _close(self, stack: list[int], tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == tag:
                self._pop(stack, k)
                return
            if self.tag[stack[k]] in ("td", "th") and tag not in BLOCK:
                return
        if (tag == "p" or tag == "br") and not self.hidden[stack[-1]]:
            self.pieces.append((stack[-1], None))

    def features(self) -> np.ndarray:
        """One row of numbers for each node."""
        n = len(self.tag)
        parent = np.array(self.parent)
        own = np.zeros(n)
        words = np.zeros(n)
        for node, text in self.pieces:
            if text is not None:
                own[node] += len(text)
                words[node] += text.count(" ") + 1
        tag = self.tag
        total, links, tags, paragraphs, tokens = own.copy(), np.array([x if t == "a" else 0 for x, t in zip(own, tag, strict=True)]), np.ones(n), np.array([float(t == "p") for t in tag]), words
        depth, order, siblings = np.zeros(n), np.zeros(n), np.zeros(n)
        apart = np.array([float(t in APART) for t in tag])
        named = np.array([len(x & NAMES_APART) for x in self.names], float)
        textual = np.array([float(t in TEXTUAL) for t in tag])
        good = np.array([len(x & NAMES_TEXT) for x in self.names], float)
        above_apart, above_named, above_text = apart.copy(), named.copy(), textual.copy()
        for i in range(1, n):
            p = self.parent[i]
            depth[i] = depth[p] + 1
            order[i] = siblings[p]
            siblings[p] += 1
            above_apart[i] += above_apart[p]
            above_named[i] += above_named[p]
            above_text[i] += above_text[p]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            total[p] += total[i]
            links[p] += total[i] if tag[i] == "a" else links[i]
            tags[p] += tags[i]
            paragraphs[p] += paragraphs[i]
        up = np.maximum(parent, 0)
        share = total / max(1.0, total[0])
        return np.stack([
            np.log1p(total), np.log1p(own), links / np.maximum(1, total), total / tags, share, total / np.maximum(1, total[up]), np.log1p(tags), np.log1p(paragraphs),
            depth, order, siblings[up], order / np.maximum(1, siblings[up]), apart, named, textual, good, above_apart, above_named, above_text,
            np.array([float(t in BLOCK) for t in tag]), np.array([float(t == "p") for t in tag]), np.array([float(t[0] == "h" and t[1:].isdigit()) for t in tag]), tokens / np.maximum(1, own),
            links[up] / np.maximum(1, total[up]),
        ], axis=1)

    def labels(self) -> np.ndarray:
        """Weak labels: inside the element that the page's title leads to, but not in a part named otherwise."""
        n = len(self.tag)
        text = self._titled()
        if text is None:
            # the element whose own paragraphs have most text
            weight = np.zeros(n)
            for node, piece in self.pieces:
                if piece is not None and self.tag[node] == "p":
                    weight[self.parent[node]] += len(piece)
            text = int(weight.argmax()) if weight.any() else None
        out = np.zeros(n, np.int64)
        for i in range(n):
            if i == text:
                out[i] = 1
            elif i and out[self.parent[i]] and self.tag[i] not in APART and not self.names[i] & NAMES_APART:
                out[i] = 1
        return out

    def _titled(self) -> int | None:
        """The least element that has the page's title as the text of a part of its own, and more text than that."""
        own = [[] for _ in self.tag]
        for node, piece in self.pieces:
            if piece is not None:
                own[node].append(piece)
        told = [" ".join(unescape("".join(x)).split()) for x in own]
        title = next((t for t, tag in zip(told, self.tag, strict=True) if tag == "title" and t), None)
        at = title and next((i for i, (t, tag) in enumerate(zip(told, self.tag, strict=True)) if tag != "title" and t and (t == title or len(t) >= 20 and (t.startswith(title) or title.startswith(t)))), None)
        if not at:
            return None
        total = np.array([float(len(t)) for t in told])
        for i in range(len(total) - 1, 0, -1):
            total[self.parent[i]] += total[i]
        up = at
        while up > 0 and total[up] <= 2 * len(told[at]):
            up = self.parent[up]
        return up if up > 0 else None

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """Nodes inside the text under the best labelling: outside, then inside, then left out, along each path."""
        n = len(odds)
        # what a subtree gains over all nodes outside, by the state that its parent hands down
        inside = odds.copy()
        outside, apart = np.zeros(n), np.zeros(n)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            # under a node inside: stay inside or be left out; under one outside: stay outside or begin
            inside[p] += max(inside[i], apart[i])
            outside[p] += max(outside[i], inside[i])
        state = np.zeros(n, np.int64)
        for i in range(1, n):
            above = state[self.parent[i]]
            if above == 0:
                state[i] = int(inside[i] > outside[i])
            elif above == 1:
                state[i] = 1 if inside[i] >= 0 else 2
            else:
                state[i] = 2
        return state == 1

    def text(self, keep: np.ndarray) -> str:
        """Blocks of the kept pieces, white space collapsed, joined by line ends."""
        blocks, now = [], []
        for node, piece in self.pieces:
            if piece is None:
                blocks.append(now)
                now = []
            elif keep[node]:
                now.append(piece)
        blocks.append(now)
        lines = (" ".join(unescape("".join(b)).split()) for b in blocks if b)
        return "\n".join(x for x in lines if x)


class Trees:
    """Gradient-boosted regression trees for a yes or no, on binned features."""

    def __init__(self):
        self.base, self.cuts, self.trees = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            # nodes of a full tree: feature, bin, value
            feature, split, value = np.full(2**DEPTH - 1, -1), np.zeros(2**DEPTH - 1, np.int64), np.zeros(2 ** (DEPTH + 1) - 1)
            where = np.zeros(len(y), np.int64)
            for node in range(2**DEPTH - 1):
                rows = np.flatnonzero(where == node)
                best = self._best(binned[rows], g[rows], h[rows]) if len(rows) >= 2 * LEAF else None
                if best is None:
                    where[rows] = 2 * node + 1
                    continue
                feature[node], split[node] = best
                where[rows] = 2 * node + 1 + (binned[rows, best[0]] > best[1])
            sums, weights = np.bincount(where, g, len(value)), np.bincount(where, h, len(value))
            value = np.clip(RATE * sums / (weights + 1), -3, 3)
            score += value[where]
            self.trees.append((feature, split, value))
        return self

    @staticmethod
    def _best(binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        found, top = None, 1e-6
        whole = g.sum() ** 2 / (h.sum() + 1)
        for f in range(binned.shape[1]):
            a, b, n = (np.cumsum(np.bincount(binned[:, f], w, BINS + 1))[:-1] for w in (g, h, np.ones(len(g))))
            gain = a**2 / (b + 1) + (g.sum() - a) ** 2 / (h.sum() - b + 1) - whole
            gain[(n < LEAF) | (len(g) - n < LEAF)] = -1
            k = int(gain.argmax())
            if gain[k] > top:
                found, top = (f, k), gain[k]
        return found

    def odds(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, split, value in self.trees:
            where = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[where]
                right = (f >= 0) & (binned[rows, f] > split[where])
                where = 2 * where + 1 + right
            score += value[where]
        return score


def learn(table: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Trees | None:
    """Train on at most SAMPLE_NODES nodes of at most SAMPLE_PAGES pages, chosen by a hash of the id."""
    sample = table.where(F.col(html_col).isNotNull()).select(F.col(html_col).alias("html"), F.xxhash64(id_col).alias("o"))
    chosen = thinned(sample.select("o"), "o", SAMPLE_PAGES).orderBy("o").limit(SAMPLE_PAGES)
    last = chosen.agg(F.max("o")).first()[0]
    if last is None:
        return None

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            read = [Page(h) for h in batch.column(0).to_pylist()]
            x, y = np.concatenate([p.features() for p in read]), np.concatenate([p.labels() for p in read])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            return pa.RecordBatch.from_arrays([flat, pa.array(y)], ["x", "y"])

        return step

    nodes = arrow_map(sample.where(F.col("o") <= last).select("html"), "x array<double>, y bigint", make)
    found = nodes.orderBy(F.xxhash64("x")).limit(SAMPLE_NODES).toArrow()
    if not found.num_rows:
        return None
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1)
    return Trees().fit(x, found["y"].to_numpy().astype(float))


def extract(html: str | None, trees: Trees | None) -> str:
    return extract_all([html], trees)[0]


def extract_all(htmls: list[str | None], trees: Trees | None) -> list[str]:
    """Texts of several pages; nodes are scored some pages at a time."""
    out: list[str] = []
    for at in range(0, len(htmls), 64):
        read = [Page(h or "") for h in htmls[at : at + 64]]
        if trees is None:
            out += [p.text(p.labels() == 1) for p in read]
            continue
        odds = trees.odds(np.concatenate([p.features() for p in read]))
        k = 0
        for p in read:
            n = len(p.tag)
            out.append(p.text(p.decode(odds[k : k + n])))
            k += n
    return out


def html_text(table: DataFrame, trees: Trees | None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of each page."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = extract_all(batch.column(2).to_pylist(), trees)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, "url", "text", "n_chars"])

        return step

    kinds = {c: table.schema[c].dataType.simpleString() for c in (id_col, "url")}
    return arrow_map(table.select(id_col, "url", html_col), f"`{id_col}` {kinds[id_col]}, url {kinds['url']}, text string, n_chars bigint", make)


def op4_html_text(spark, sf_dir):
    table = pages(spark, sf_dir)
    return html_text(table, learn(table))
