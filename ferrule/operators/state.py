"""State of a dataset: newest row of each id over base, deltas and log, and what is read, folded and kept of it.

A log has id, lsn, deleted and what the rows carry.  Cold rows are those of a
base and its deltas; an id that the log has is the log's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: str = "id", order: str = "lsn") -> DataFrame:
    """The row of each key that comes last; partial aggregates travel, not all rows."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in rest])


def live(rows: DataFrame) -> DataFrame:
    """Newest rows that are not deleted."""
    return last_wins(rows).where(~F.col("deleted"))


def numbered(rows: DataFrame, dataset: str, order: str, first: int = 1) -> DataFrame:
    """The rows with an lsn that counts up from first within each dataset, in their order."""
    number = F.row_number().over(Window.partitionBy(dataset).orderBy(order))
    return rows.withColumn("lsn", F.lit(first - 1) + number.cast("bigint"))


def since(log: DataFrame, watermark: int) -> DataFrame:
    """The newest row of each id, tombstones included, of those that were written after the watermark."""
    return last_wins(log).where(F.col("lsn") > watermark)


def upto(log: DataFrame, watermark: int) -> DataFrame:
    """The newest row of each id as of the watermark."""
    return last_wins(log.where(F.col("lsn") <= watermark))


def high_water(log: DataFrame) -> int:
    """The last lsn that was given, 0 for an empty log."""
    return log.agg(F.coalesce(F.max("lsn"), F.lit(0))).first()[0]


def held(log: DataFrame) -> DataFrame:
    """n, watermark: how many ids the log has and its last lsn."""
    return log.agg(F.count_distinct("id").alias("n"), F.max("lsn").alias("watermark"))


def without(cold: DataFrame, newer: DataFrame) -> DataFrame:
    """Cold rows whose id nothing newer has."""
    return cold.join(newer.select("id"), "id", "left_anti").select(cold.columns)


def with_newer(cold: DataFrame, newer: DataFrame) -> DataFrame:
    """Cold rows whose id is written anew."""
    return cold.join(newer.select("id"), "id", "left_semi").select(cold.columns)


def united(cold: DataFrame, log: DataFrame) -> DataFrame:
    """The live rows of both, with the cold rows' columns."""
    newest = last_wins(log)
    return without(cold, newest).unionByName(newest.where(~F.col("deleted")).select(cold.columns))


def points(cold: DataFrame, log: DataFrame, ids: list[str]) -> DataFrame:
    """The live rows of a few ids, with the tier that has them: 0 for the log, 1 for cold rows; both are filtered before they meet."""
    asked = F.col("id").isin(*ids)
    newest = last_wins(log.where(asked))
    found = newest.where(~F.col("deleted")).select(cold.columns).withColumn("tier", F.lit(0))
    return found.unionByName(without(cold.where(asked), newest).withColumn("tier", F.lit(1)))


def page(rows: DataFrame, limit: int, after: str | None = None, skip: int = 0) -> DataFrame:
    """Rows by id: so many after an id, or after so many others."""
    rows = rows if after is None else rows.where(F.col("id") > after)
    return rows.orderBy("id").offset(skip).limit(limit) if skip else rows.orderBy("id").limit(limit)


def gone(log: DataFrame, tombstones: DataFrame) -> DataFrame:
    """id: those that cold tiers may not answer with: all that the log has, and those of tombstones carried in deltas."""
    return log.select("id").union(tombstones.select("id")).distinct()


def stacked(*bands: DataFrame) -> DataFrame:
    """Base and deltas as one, with the band that each row is of, 1 for the base."""
    out = None
    for number, rows in enumerate(bands, 1):
        rows = rows.withColumn("band", F.lit(number))
        out = rows if out is None else out.unionByName(rows)
    return out


def compacted(bands: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The newest row of each id over all bands; a tombstone (id, band) hides the rows of its own band and of those before."""
    newest = last_wins(bands, "id", "band")
    dead = tombstones.groupBy("id").agg(F.max("band").alias("hidden"))
    return newest.join(dead, "id", "left").where(F.col("hidden").isNull() | (F.col("band") > F.col("hidden"))).select(newest.columns)


def folded(log: DataFrame, frontier: int) -> DataFrame:
    """What a delta over this frontier covers: lo, hi, row_count, tombstones."""
    rows = since(log, frontier)
    return rows.agg(F.lit(frontier + 1).cast("bigint").alias("lo"), F.max("lsn").alias("hi"), F.count(F.lit(1)).alias("row_count"), F.count_if("deleted").alias("tombstones"))


def appended(base: DataFrame, rows: DataFrame) -> DataFrame:
    """The base with rows added to it; rows of an id that it has take their place."""
    return without(base, rows).unionByName(rows.select(base.columns))


def deleted(base: DataFrame, ids: list[str]) -> DataFrame:
    """The base without these ids; ids that it lacks do no harm."""
    return base.where(~F.col("id").isin(*ids))


def new_parts(found: DataFrame, built: DataFrame) -> DataFrame:
    """part: those that came and that no build has."""
    return found.select("part").distinct().join(built.select("part"), "part", "left_anti")


def idle(rows: DataFrame, dataset: str, written: str, before: Column) -> DataFrame:
    """dataset, newest: those that were last written at a time or before it."""
    return rows.groupBy(dataset).agg(F.max(written).cast("bigint").alias("newest")).where(F.col("newest") <= before)


def named_hits(hits: DataFrame, names: DataFrame) -> DataFrame:
    """Hits by number (hit) with their ids; a number that has no name stands for itself, and -1 is no hit."""
    found = hits.where(F.col("hit") != -1).join(names.select("hit", "id"), "hit", "left")
    return found.select(*hits.columns, F.coalesce("id", F.col("hit").cast("string")).alias("id"))


def consolidate(base: DataFrame, log: DataFrame, watermark: int) -> DataFrame:
    """Base rows without newer ones, and the log's live rows up to the watermark."""
    return united(base, log.where(F.col("lsn") <= watermark))


def trim(log: DataFrame, grace: int) -> DataFrame:
    return log if grace <= 0 else log.where(F.col("lsn") > grace)


def spread(rows: DataFrame, by: str, value: str, **shares: float) -> DataFrame:
    """Exact percentiles of a value, named and rounded to 6 digits."""
    return rows.groupBy(by).agg(*[F.round(F.percentile(value, share), 6).alias(name) for name, share in shares.items()])
