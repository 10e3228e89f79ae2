"""Generations of shards: a base and the deltas on it, how far they reach, and what nothing needs any more.

shards has shard, dataset, level (0 for a base, 1 for a delta), parent, quantizer,
lo, hi, consolidated, created.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(shards: DataFrame) -> DataFrame:
    """dataset, shard: the newest shard of each dataset."""
    return shards.groupBy("dataset").agg(F.max_by("shard", F.struct("created", "shard")).alias("shard"))


def members(shards: DataFrame) -> DataFrame:
    """dataset, base, generation (1 is the newest), shard, lo (-1 for the base), hi; a delta of another quantizer is in none."""
    order = Window.partitionBy("dataset").orderBy(F.desc("created"), F.desc("shard"))
    reach = F.when(F.col("hi") == 0, F.col("consolidated")).otherwise(F.col("hi"))
    bases = shards.where("level = 0").select(F.col("shard").alias("base"), "dataset", "quantizer", reach.alias("reach"), F.row_number().over(order).cast("bigint").alias("generation"))
    deltas = shards.where("level = 1").select("shard", F.col("parent").alias("base"), "quantizer", "lo", "hi")
    of_bases = bases.select("dataset", "base", "generation", F.col("base").alias("shard"), F.lit(-1).alias("lo"), F.col("reach").alias("hi"))
    return of_bases.unionByName(bases.join(deltas, ["base", "quantizer"]).select(of_bases.columns))


def frontiers(shards: DataFrame) -> DataFrame:
    """dataset, base, generation, frontier: how far each generation reaches without a gap or an overlap."""
    order = Window.partitionBy("base").orderBy("lo", "shard")
    walked = members(shards).withColumn("ok", (F.col("lo") == -1) | F.coalesce(F.col("lo") == F.lag("hi").over(order) + 1, F.lit(False)))
    so_far = F.min("ok").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return walked.withColumn("all_ok", so_far).where("all_ok").groupBy("dataset", "base", "generation").agg(F.max("hi").alias("frontier"))


def dataset_watermark(shards: DataFrame) -> DataFrame:
    """dataset, watermark: the frontier of the newest generation."""
    return frontiers(shards).where("generation = 1").select("dataset", F.col("frontier").alias("watermark"))


def grace_watermark(shards: DataFrame, keep: int = 2) -> DataFrame:
    """dataset, grace: the frontier of the oldest generation that is kept, 0 where there are fewer."""
    oldest = F.max(F.when(F.col("generation") == keep, F.col("frontier")))
    return frontiers(shards).groupBy("dataset").agg(F.coalesce(oldest, F.lit(0)).alias("grace"))


def superseded(shards: DataFrame, keep: int = 2) -> DataFrame:
    """shard: those in none of the newest generations that are kept."""
    return shards.join(members(shards).where(F.col("generation") <= keep).select("shard"), "shard", "left_anti").select("shard")


def watermark_carry(shards: DataFrame) -> DataFrame:
    """shard, dataset, consolidated: the highest watermark up to each shard; a build that consolidates nothing carries it on."""
    order = Window.partitionBy("dataset").orderBy("created", "shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return shards.select("shard", "dataset", F.max("consolidated").over(order).alias("consolidated"))
