"""Benchmark decontamination with a BM25 inverted index and block-max WAND.

The test items are the indexed documents.  Postings are in item order and cut
into blocks that know their largest contribution, each weighed by what its item needs
to be found, so that one is the threshold of all.  Every passage of every
training text is a query: overlapping windows of words, whole text.  A window
in which no item's rare terms weigh enough to reach the threshold, were all its
other terms there, is passed over; the others run block-max WAND, which skips
blocks that can't reach it.  What is retrieved is
verified: the item's five-word shingles must occur in the text around the window
to COVER at least, in the first part (question) and in the last (answer).

Results in odd cases: null, empty or shorter texts match nothing; items of fewer
than five words are one shingle, and items without words are never found; items
with equal texts are each found; rows that repeat a document or an item repeat
nothing in the result beyond the row itself; an empty table gives an empty
result; without items nothing is found and every document stays; other columns,
whatever their names, are passed over, or kept where documents are returned.
"""

from __future__ import annotations

import uuid
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, documents, forget, kept, stored, text_bytes

WIDTH, COVER = 5, 0.8
#: BM25 weights; share of an item's own score that a window must reach; share
#: that common terms may have of it; postings of a block.
K1, B, SHARE, REST, POSTINGS = 1.2, 0.75, 0.6, 0.25, 16
#: Items and bytes of one index, which tasks hold, on average; a larger benchmark is searched index after index, in blocks.
ITEMS, ITEM_BYTES = 20_000, 16 << 20


def words_of(data: bytes) -> list[bytes]:
    return data.lower().split()


def shingles(words: list[bytes]) -> set[tuple]:
    if len(words) < WIDTH:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(WIDTH)), strict=False))


class Index:
    """BM25 postings of the items with the bounds that WAND needs."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = [(i, w) for i, data in items if (w := words_of(data))]
        self.ids = [i for i, _ in self.items]
        lengths = [len(w) for _, w in self.items]
        mean = sum(lengths) / max(1, len(lengths))
        found: dict[bytes, list[tuple[int, float]]] = {}
        counts = [Counter(w) for _, w in self.items]
        df = Counter(t for c in counts for t in c)
        n = len(self.items)
        self.full = np.zeros(n)
        for at, c in enumerate(counts):
            for t, f in c.items():
                idf = log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                weight = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * lengths[at] / mean))
                found.setdefault(t, []).append((at, weight))
                self.full[at] += weight
        self.terms = {t: k for k, t in enumerate(found)}
        self.posted = [np.array([p[0] for p in ps]) for ps in found.values()]
        self.weights = [np.array([p[1] for p in ps]) for ps in found.values()]
        self.last = [[int(p[min(b + POSTINGS, len(p)) - 1]) for b in range(0, len(p), POSTINGS)] for p in self.posted]
        # shares of what their items need; a window reaches an item with shares of one in all
        self.shares = [w / (SHARE * self.full[p]) for w, p in zip(self.weights, self.posted, strict=True)]
        self.most = [[float(w[b : b + POSTINGS].max()) for b in range(0, len(w), POSTINGS)] for w in self.shares]
        self.bound = np.array([w.max() for w in self.shares] + [0.0])
        self.need = SHARE * self.full
        self.longest = max(lengths, default=0)
        # an item's rare terms: the others weigh REST of its score, so a window needs need - REST from these
        own: list[list[tuple]] = [[] for _ in range(n)]
        for t, k in self.terms.items():
            for at, weight in zip(self.posted[k].tolist(), self.weights[k].tolist(), strict=True):
                own[at].append((df[t], -len(t), k, weight))
        rare: list[list[tuple[int, float]]] = [[] for _ in range(len(self.terms) + 1)]
        self.lack = np.zeros(n)
        for at, terms in enumerate(own):
            rest = self.full[at]
            for _, _, k, weight in sorted(terms):
                if rest <= REST * self.full[at]:
                    break
                rare[k].append((at, weight))
                rest -= weight
            self.lack[at] = (self.need[at] - rest) * (1 - 1e-9)
        self.rare_size = np.array([len(r) for r in rare])
        self.rare_start = np.concatenate([[0], np.cumsum(self.rare_size)])[:-1]
        self.rare_item = np.array([i for r in rare for i, _ in r], np.int64)
        self.rare_weight = np.array([w for r in rare for _, w in r])
        self.sets = [shingles(w) for _, w in self.items]
        cut = [max(1, 2 * len(w) // 3) for _, w in self.items]
        self.question = [shingles(w[:c]) for (_, w), c in zip(self.items, cut, strict=True)]
        self.answer = [shingles(w[c:] if len(w) - c >= WIDTH else w[-WIDTH:]) for (_, w), c in zip(self.items, cut, strict=True)]

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """Items whose BM25 score for these terms reaches their threshold."""
        lists = [[0, t] for t in terms]
        posted, out, enough = self.posted, [], 1 - 1e-9
        while True:
            lists = sorted((c for c in lists if c[0] < len(posted[c[1]])), key=lambda c: posted[c[1]][c[0]])
            total, pivot = 0.0, None
            for k, (_, t) in enumerate(lists):
                total += self.bound[t]
                if total >= enough:
                    pivot = k
                    break
            if pivot is None:
                return out
            item = int(posted[lists[pivot][1]][lists[pivot][0]])
            while pivot + 1 < len(lists) and posted[lists[pivot + 1][1]][lists[pivot + 1][0]] == item:
                pivot += 1
            # the blocks that would hold the pivot item
            bound, edge = 0.0, None
            for c in lists[: pivot + 1]:
                b = c[0] // POSTINGS
                while b < len(self.last[c[1]]) and self.last[c[1]][b] < item:
                    b += 1
                if b < len(self.last[c[1]]):
                    bound += self.most[c[1]][b]
                    edge = self.last[c[1]][b] if edge is None else min(edge, self.last[c[1]][b])
            if bound >= enough:
                score = share = 0.0
                for c in lists[: pivot + 1]:
                    c[0] += int(np.searchsorted(posted[c[1]][c[0] :], item))
                    if c[0] < len(posted[c[1]]) and posted[c[1]][c[0]] == item:
                        score += float(self.weights[c[1]][c[0]])
                        share += float(self.shares[c[1]][c[0]])
                        c[0] += 1
                if share >= enough:
                    out.append((item, score))
            else:
                # no item up to the nearest block end can pass
                to = edge + 1 if edge is not None and edge >= item else item + 1
                if pivot + 1 < len(lists):
                    to = max(item + 1, min(to, int(posted[lists[pivot + 1][1]][lists[pivot + 1][0]])))
                for c in lists[: pivot + 1]:
                    c[0] += int(np.searchsorted(posted[c[1]][c[0] :], to))

    def hopeful(self, terms: np.ndarray, step: int) -> np.ndarray:
        """Starts of the windows in which an item's rare terms weigh enough for it to pass."""
        at = np.flatnonzero(self.rare_size[terms])
        if not len(at):
            return at
        size = self.rare_size[terms[at]]
        where = np.repeat(self.rare_start[terms[at]] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        n, term = len(self.ids), np.repeat(terms[at], size)
        window = np.repeat(at // step, size)
        key = ((window + 1) * n + self.rare_item[where]) * (len(self.terms) + 1) + term
        # a place lies in the window that starts before it and in the one before that
        key, once = np.unique(np.concatenate([key, key - n * (len(self.terms) + 1)]), return_index=True)
        weight = self.rare_weight[where][once % len(where)]
        cell, first = np.unique(key // (len(self.terms) + 1), return_index=True)
        total = np.add.reduceat(weight, first)
        good = cell[total >= self.lack[cell % n]]
        return np.unique(np.maximum(good // n - 1, 0)) * step

    def search(self, data: bytes) -> list[tuple[int, float, float]]:
        """item id, best window's score and share of its shingles, for each item that the text contains."""
        words = words_of(data)
        n, none = len(words), len(self.terms)
        if not n or not self.items:
            return []
        get = self.terms.get
        terms = np.fromiter((get(w, none) for w in words), np.int64, n)
        # windows of twice the longest item, moved by it: each item lies whole in one
        step = self.longest
        span = 2 * step
        hopeful = self.hopeful(terms, step)
        best: dict[int, float] = {}
        held: dict[int, tuple[int, int]] = {}
        for s in hopeful:
            own = np.unique(terms[s : s + span])
            own = own[own < none]
            for item, score in self.wand(own.tolist()):
                best[item] = max(score, best.get(item, 0.0))
                a, b = held.get(item, (n, 0))
                held[item] = (min(a, int(s)), max(b, int(s) + span))
        out = []
        for item, (a, b) in held.items():
            here = shingles(words[a:b]) if len(self.items[item][1]) >= WIDTH else {tuple(words[k : k + len(self.items[item][1])]) for k in range(a, min(b, n))}
            cover = len(self.sets[item] & here) / len(self.sets[item])
            parts = (self.question[item], self.answer[item]) if len(self.items[item][1]) >= WIDTH else (self.sets[item],)
            if cover >= COVER and all(p & here for p in parts):
                out.append((self.ids[item], best[item], cover))
        return out


def item_blocks(items: DataFrame, item_col: str):
    """Rows (item, text) of one block of the distinct test items after the other, each of about ITEMS items and ITEM_BYTES at most."""
    held = stored(items.select(F.col(item_col).cast("bigint").alias("item"), F.coalesce("text", F.lit("")).alias("text")).distinct(), "test-items")
    size = held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    count = max(1, -(-size["n"] // ITEMS), -(-size["bytes"] // ITEM_BYTES))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    for k in range(count):
        yield held.where(part == k).collect()
    forget(held)


def _blocks(items: DataFrame, item_col: str) -> list:
    spark = items.sparkSession
    return [(spark.sparkContext.broadcast([(r["item"], r["text"].encode()) for r in block]), uuid.uuid4().hex) for block in item_blocks(items, item_col)]


def _index(held) -> Index:
    """The block's index, which a worker keeps until it gets another block."""
    block, mark = held
    return kept("test item index", lambda: Index(block.value), mark)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, score, coverage for each document and each test item that it contains."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, found = docs.schema["id"].dataType.simpleString(), None
    for held in _blocks(items, item_col):

        def make(held=held):
            index = _index(held)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                rows = [(own, *hit) for own, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True) for hit in index.search(data)]
                if not rows:
                    return None
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (batch.schema.types[0], pa.int64(), pa.float64(), pa.float64()), strict=True)], ["id", "item", "score", "coverage"])

            return step

        hits = arrow_map(docs, f"id {kind}, item bigint, score double, coverage double", make)
        found = hits if found is None else found.union(hits)
    return found.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "score", "coverage")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The documents that contain no test item, with all columns."""
    at = docs.columns.index(text_col)
    for held in _blocks(items, item_col):

        def make(held=held):
            index = _index(held)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                return batch.filter(pa.array([not index.search(x) for x in text_bytes(batch.column(at))], pa.bool_()))

            return step

        docs = arrow_map(docs, docs.schema, make)
    return docs


def op9_decontaminate(spark, sf_dir):
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
