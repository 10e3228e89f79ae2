"""Exact and cell-pruned nearest-neighbour search, and its merge with recent writes.

Order is by distance as it is, then (where tiers are merged) by tier, then by id.
Records whose values are null, of another length, or not all numbers have no
distance and are never found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import l2_squared, metadata_matches
from ..plans.cells import HELD, PROBED, nearest, vectors_of

#: Queries that are broadcast at once at most; more are searched block after block.
QUERY_BLOCK = 8192
#: Queries and records of one block product of distances (8 MB).
SIDE = 1 << 10
#: Records for which the number of probed cells is fitted, and the share of their nearest that it must reach.
CALIBRATED, SHARE = 200, 0.95


def has_distance(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score)


def knn(records: DataFrame, vector: list[float], k: int, wanted: dict | None = None) -> DataFrame:
    """The k nearest records of one vector, id and score, ties by id; the filter comes before the cut."""
    if wanted:
        records = records.where(metadata_matches(F.col("metadata"), wanted))
    score = l2_squared(F.col("values"), F.array(*[F.lit(float(x)).cast("float") for x in vector]))
    return records.where(F.size("values") == len(vector)).select("id", score.alias("score")).where(has_distance(F.col("score"))).orderBy("score", "id").limit(k)


def _first(q: np.ndarray, r: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which pairs are among the k first of their query, by score, then by record."""
    order = np.lexsort((r, score, q))
    own = q[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def _best(vectors: np.ndarray, queries: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, record and distance of the k nearest records (rows with finite numbers) of each query, ties by row; none farther than the query's bound.

    Block products of SIDE queries and records tell which can be among them, with
    room for their rounding; the distances of these are then summed from the differences.
    """
    size, far = (vectors**2).sum(1), (queries**2).sum(1)
    found = []
    for a in range(0, len(queries), SIDE):
        ask, parts = queries[a : a + SIDE], []
        top = np.full(len(ask), np.inf) if bound is None else bound[a : a + SIDE]
        for b in range(0, len(vectors), SIDE):
            own = vectors[b : b + SIDE]
            # more than the product can be off by
            room = 1e-9 * (size[b : b + SIDE].max() + far[a : a + SIDE]) + 1e-300
            rough = size[b : b + SIDE] - 2 * ask @ own.T
            rough += far[a : a + SIDE, None]
            near = rough <= (top + room)[:, None]
            if len(own) > k and np.count_nonzero(near) > 2 * k * len(ask):
                top = np.minimum(top, np.partition(rough, k - 1, axis=1)[:, k - 1] + room)
                near = rough <= (top + room)[:, None]
            q, r = np.nonzero(near)
            score = np.empty(len(q))
            for at in range(0, len(q), 1 << 14):
                part = slice(at, at + (1 << 14))
                score[part] = ((own[r[part]] - ask[q[part]]) ** 2).sum(1)
            part = a + q, b + r, score
            if len(q) > 2 * k * len(ask):  # many ties
                keep = _first(*part, k)
                part = tuple(x[keep] for x in part)
            parts.append(part)
        if parts:
            part = tuple(map(np.concatenate, zip(*parts, strict=True)))
            keep = _first(*part, k)
            found.append(tuple(x[keep] for x in part))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


class Nearest:
    """The k nearest of the records seen so far for each query of a block, ties by id."""

    def __init__(self, queries: np.ndarray, k: int, probed: tuple[np.ndarray, np.ndarray] | None = None):
        self.queries, self.k, self.probed = queries, k, probed
        self.bound, self.held = np.full(len(queries), np.inf), None

    def add(self, ids: pa.Array, vectors: np.ndarray, cell: np.ndarray | None = None) -> None:
        """More records, with their cells where only the queries that probe a record's cell are to see it."""
        order = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()
        ids, vectors = ids.take(pa.array(order)), vectors[order]
        if cell is None:
            self._merge(ids, *_best(vectors, self.queries, self.k, self.bound))
            return
        cell, (asks, starts) = cell[order], self.probed
        by_cell, waiting, pairs = np.argsort(cell, kind="stable"), [], 0
        for row in np.split(by_cell, np.flatnonzero(np.diff(cell[by_cell])) + 1):
            c = cell[row[0]]
            ask = asks[starts[c] : starts[c + 1]] if 0 <= c < len(starts) - 1 else asks[:0]
            if len(ask):
                q, r, score = _best(vectors[row], self.queries[ask], self.k, self.bound[ask])
                waiting.append((ask[q], row[r], score))
                pairs += len(q)
                if pairs > HELD:
                    self._merge(ids, *map(np.concatenate, zip(*waiting, strict=True)))
                    waiting, pairs = [], 0
        if waiting:
            self._merge(ids, *map(np.concatenate, zip(*waiting, strict=True)))

    def _merge(self, ids: pa.Array, q: np.ndarray, r: np.ndarray, score: np.ndarray) -> None:
        keep = _first(q, r, score, self.k)
        q, r, score = q[keep], r[keep], score[keep]
        if not len(q):
            return
        table = pa.table({"q": q.astype(np.int64), "id": ids.take(pa.array(r)), "score": score})
        if self.held is not None:
            table = pa.concat_tables([self.held, table])
        table = table.take(pc.sort_indices(table, [("q", "ascending"), ("score", "ascending"), ("id", "ascending")], null_placement="at_start"))
        q = table["q"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.held = table.filter(pa.array(place < self.k)).combine_chunks()
        last = place == self.k - 1
        self.bound[q[last]] = table["score"].to_numpy()[last]

    def rows(self, qids: pa.Array) -> list[pa.RecordBatch]:
        """qid, id, score of all that is held."""
        return [] if self.held is None else [pa.RecordBatch.from_arrays([qids.take(b.column(0)), b.column(1), b.column(2)], ["qid", "id", "score"]) for b in self.held.to_batches(10000)]


def _searched(records: DataFrame, queries: DataFrame, k: int, centroids: np.ndarray | None = None, nprobe: int = 0) -> DataFrame:
    """qid, id, score, rank: each query's k nearest among all records, or among those of its nprobe nearest cells.

    Queries are taken in blocks of QUERY_BLOCK, or fewer where HELD numbers hold no
    more of them; a block is broadcast. Each task keeps the best of each query over
    all its records and cells before anything is exchanged.
    """
    spark, found = records.sparkSession, None
    asked = queries.agg(F.count(F.lit(1)), F.max(F.size("query"))).first()
    cells = None if centroids is None else max(1, len(centroids))
    # a search of all cells reads all records that have one
    pruned = cells is not None and nprobe < cells
    if cells is not None and not pruned:
        records = records.where(F.col("cell").between(0, cells - 1))
    size = max(1, min(QUERY_BLOCK, HELD // max(1, asked[1] or 0, k, nprobe if pruned else 0)))
    count = max(1, -(-asked[0] // size))
    kinds = queries.schema["qid"].dataType.simpleString(), records.schema["id"].dataType.simpleString()
    columns = ["id", "values"] + ["cell"] * pruned
    for block in range(count):
        own = queries.select("qid", "query").where(F.col("query").isNotNull() & (F.pmod(F.xxhash64("qid"), F.lit(count)) == block)).toArrow()
        dimension = max(own["query"].combine_chunks().value_lengths().to_pylist(), default=0)
        good, vectors = vectors_of(own["query"].combine_chunks(), dimension)
        probed = probing(nearest(vectors, centroids, nprobe), cells) if pruned else None
        held = spark.sparkContext.broadcast((own["qid"].combine_chunks().take(pa.array(good)), vectors, probed))

        def run(batches, held=held, dimension=dimension):
            qids, asked, probed = held.value
            best = Nearest(asked, k, probed)
            for batch in batches:
                rows, vectors = vectors_of(batch.column(1), dimension)
                if len(rows) and len(qids):
                    cell = None if probed is None else batch.column(2).to_numpy(zero_copy_only=False)[rows]
                    best.add(batch.column(0).take(pa.array(rows)), vectors, cell)
            yield from best.rows(qids)

        best = records.select(*columns).mapInArrow(run, f"qid {kinds[0]}, id {kinds[1]}, score double")
        rank = F.row_number().over(Window.partitionBy("qid").orderBy("score", "id"))
        best = best.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)
        found = best if found is None else found.union(best)
    return found


def probing(near: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries by the cells that they probe, and where each cell's begin."""
    flat = near.ravel()
    order = np.argsort(flat, kind="stable")
    return (order // max(1, near.shape[1])).astype(np.int32), np.searchsorted(flat[order], np.arange(cells + 1))


def knn_batch(records: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, id, score, rank for a stated set of queries against all records."""
    return _searched(records, queries, k)


def merge_recent(recent: DataFrame, cold: DataFrame, k: int, suppressed: DataFrame | None = None) -> DataFrame:
    """Recent matches first, cold ones whose id no recent row holds; nearest k of both."""
    held = (suppressed if suppressed is not None else recent).select("id").distinct()
    both = recent.withColumn("tier", F.lit(0)).unionByName(cold.join(held, "id", "left_anti").withColumn("tier", F.lit(1)))
    return both.where(has_distance(F.col("score"))).orderBy("score", "tier", "id").limit(k)


def probe(records: DataFrame, centroids: np.ndarray, queries: DataFrame, nprobe: int, k: int) -> DataFrame:
    """Nearest k among the records (which have a cell) of each query's nprobe nearest cells."""
    return _searched(records, queries, k, centroids, nprobe)


def calibrate(records: DataFrame, centroids: np.ndarray, k: int) -> int:
    """Fewest probed cells whose records hold the SHARE of the true k nearest, PROBED at least.

    Measured by exact search for CALIBRATED records against all records; their own matches don't count.
    """
    if not len(centroids):
        return 1
    own = records.where("cell >= 0").orderBy(F.xxhash64("id"), "id").limit(CALIBRATED).select(F.col("id").alias("qid"), F.col("values").alias("query"))
    vectors = {r["qid"]: r["query"] for r in own.collect()}
    own = own.sparkSession.createDataFrame(list(vectors.items()), own.schema)
    exact = knn_batch(records, own, k + 1).where("id <> qid").select("qid", "id")
    # CALIBRATED * (k + 1) rows at most
    found = records.select("id", "cell").join(F.broadcast(exact), "id").select("qid", "cell").collect()
    if not found:
        return min(PROBED, len(centroids))
    order = nearest(np.asarray(list(vectors.values())), centroids, len(centroids))
    place = {q: np.argsort(o) for q, o in zip(vectors, order, strict=True)}
    ranks = np.sort([place[r["qid"]][r["cell"]] for r in found])
    return int(min(len(centroids), max(PROBED, ranks[int(np.ceil(SHARE * len(ranks))) - 1] + 1)))


def agreement(one: DataFrame, other: DataFrame) -> DataFrame:
    """qid, recall: the share of the ids that one finds for a query that the other finds too."""
    lists = lambda df, c: df.groupBy("qid").agg(F.collect_set("id").alias(c))  # noqa: E731  k ids each
    both = lists(one, "a").join(lists(other, "b"), "qid", "left")
    shared = F.size(F.array_intersect("a", F.coalesce("b", F.array().cast("array<string>"))))
    return both.select("qid", (shared / F.size("a")).alias("recall"))


def cells_for(n: Column) -> Column:
    """Number of cells for n records."""
    return F.greatest(F.lit(1), F.least(F.floor(4 * F.sqrt(n)).cast("bigint"), F.lit(4096), F.greatest(F.lit(1), (n / 8).cast("bigint"))))
