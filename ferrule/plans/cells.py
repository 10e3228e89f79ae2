"""Which layout a dataset's base gets: one cell, or cells around trained centroids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fewest records and cells for a pruned layout, most cells, default number of probed cells.
LEAST_RECORDS, LEAST_CELLS, MOST_CELLS, PROBED = 64, 4, 4096, 64
#: Records for each cell that centroids are trained on, at most; rounds of k-means, at most.
TRAINED, ROUNDS = 256, 8
#: Numbers that a step over many vectors holds at once in one matrix, whatever the batch and the number of cells (8 MB).
HELD = 1 << 20


def cell_count(records: int) -> int:
    """Cells for so many records; 1 means no pruning."""
    cells = max(1, min(int(4 * records**0.5), MOST_CELLS, max(1, records // 8)))
    return cells if records >= LEAST_RECORDS and cells >= LEAST_CELLS else 1


def vectors_of(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors of this dimension with finite numbers only, and these as a matrix."""
    if not dimension:
        return np.empty(0, np.int64), np.zeros((0, 0))
    rows = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dimension)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    matrix = flat.reshape(len(rows), dimension)
    good = np.isfinite(matrix).all(1)
    return rows[good], matrix[good]


def train(records: DataFrame) -> np.ndarray:
    """Centroids, one row each, from k-means over a sample of at most about TRAINED records a cell.

    Each round's tasks send one sum for each cell at most; the centroids (MOST_CELLS at most) come to the driver.
    """
    count = records.count()
    cells = cell_count(count)
    if cells == 1:
        return np.zeros((0, 0), np.float32)
    order = F.xxhash64("id")
    share = min(1.0, cells * TRAINED / count)
    # a hash of the id decides, so that a task that is run again takes the same records
    sample = records.where(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20))).select("id", "values").persist()
    first = sample.where(F.col("values").isNotNull()).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(cells).select("values").toArrow()["values"].combine_chunks()
    dimension = max(first.value_lengths().to_pylist(), default=0)
    centroids = np.unique(vectors_of(first, dimension)[1], axis=0)
    for _ in range(ROUNDS):
        if len(centroids) < LEAST_CELLS:
            break
        held = records.sparkSession.sparkContext.broadcast(centroids)

        def sums(batches, held=held, dimension=dimension):
            centroids = held.value
            total, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
            for batch in batches:
                _, vectors = vectors_of(batch.column(0), dimension)
                if len(vectors):
                    cell = nearest(vectors, centroids, 1)[:, 0]
                    by_cell = np.argsort(cell, kind="stable")
                    found, starts = np.unique(cell[by_cell], return_index=True)
                    total[found] += np.add.reduceat(vectors[by_cell], starts)
                    n += np.bincount(cell, minlength=len(n))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(list(total[at]), pa.list_(pa.float64()))], ["cell", "n", "total"])

        def added(table: pa.Table) -> pa.Table:
            rows = table.column("total").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
            return pa.table({"cell": table.column("cell")[:1], "centroid": pa.array([rows.sum(0) / sum(table.column("n").to_pylist())])})

        parts = sample.select("values").mapInArrow(sums, "cell int, n bigint, total array<double>")
        new = parts.groupBy("cell").applyInArrow(added, "cell int, centroid array<double>").toArrow()
        before, centroids = centroids, centroids.copy()
        centroids[new["cell"].to_numpy()] = vectors_of(new["centroid"].combine_chunks(), dimension)[1]
        if np.abs(centroids - before).max() <= 1e-6 * np.abs(before).max():
            break
    sample.unpersist()
    return centroids.astype(np.float32) if len(centroids) >= LEAST_CELLS else np.zeros((0, 0), np.float32)


def nearest(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each vector, nearest first; HELD distances are held at once."""
    if not len(centroids):
        return np.zeros((len(vectors), 1), np.int32)
    centroids = centroids.astype(np.float64)
    size, step = (centroids**2).sum(1), max(1, HELD // len(centroids))
    found = np.empty((len(vectors), min(n, len(centroids))), np.int32)
    for at in range(0, len(vectors), step):
        score = size - 2 * vectors[at : at + step].astype(np.float64) @ centroids.T
        found[at : at + step] = score.argmin(1)[:, None] if n == 1 else np.argsort(score, 1, kind="stable")[:, :n]
    return found


def assign(records: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The records with the cell of their nearest centroid; rows without a vector of their dimension get cell -1.

    The centroids (MOST_CELLS at most) are broadcast; no row leaves its task.
    """
    if not len(centroids):
        return records.withColumn("cell", F.lit(0))
    held, at = records.sparkSession.sparkContext.broadcast(centroids), records.columns.index("values")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema) + ", cell int"

    def run(batches):
        for batch in batches:
            good, vectors = vectors_of(batch.column(at), held.value.shape[1])
            cell = np.full(batch.num_rows, -1, np.int32)
            if len(good):
                cell[good] = nearest(vectors, held.value, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return records.mapInArrow(run, schema)
