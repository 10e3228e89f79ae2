"""Streaming ingest: files of record lines into the change log, once for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import TEXT, Engine
from ..sources.imports import checked
from ..sources.imports import rejected as rejected_lines


def ingest(spark: SparkSession, source: str, log: str, rejected: str, checkpoint: str, dimension: int) -> StreamingQuery:
    """Read lines as they arrive; good records go to log, others to rejected, each under its batch's folder.

    A batch that is run again overwrites its own folder, so the log holds it once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        lines = rows.select(F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))
        found = checked(lines, dimension).persist()
        found.where("reason is null").select("id", "values", "metadata", F.lit(False).alias("deleted"), F.lit(number).cast("bigint").alias("batch")).write.mode("overwrite").parquet(f"{log}/batch={number}")
        rejected_lines(found, TEXT).write.mode("overwrite").json(f"{rejected}/batch={number}")
        found.unpersist()

    return spark.readStream.text(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feed(engine: Engine, name: str, source: str, checkpoint: str, most_rows: int = 2000) -> StreamingQuery:
    """Append good records of arriving lines to a dataset, each batch once, and fold its log when it grows.

    Bad lines go to the dataset's rejected folder under the batch's number.  A
    batch that is run again after a failure is passed over if it was committed.
    """
    dimension = engine.describe(name)["dimension"]

    def batch(rows: DataFrame, number: int) -> None:
        found = checked(rows.select(F.monotonically_increasing_id().alias("line"), F.col("value").alias("text")), dimension).persist()
        try:
            rejected_lines(found, TEXT).write.mode("overwrite").json(f"{engine.root}/{name}/rejected/stream-{number}")
            engine.upsert(name, found.where("reason is null").select("id", "values", "metadata"), (checkpoint, number))
        finally:
            found.unpersist()
        log = engine.describe(name)["log"]
        if log and log[-1]["hi"] - log[0]["lo"] + 1 > most_rows:
            engine.consolidate(name)

    return engine.spark.readStream.text(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
