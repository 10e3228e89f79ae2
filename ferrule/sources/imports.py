"""Newline-delimited records: parsing, checks in a fixed order, and the job's outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "id string, values array<double>, metadata string"


# Longest id of a record and largest magnitude of a 32-bit float.
LONGEST_ID, LARGEST = 256, 3.4028234663852886e38


#: What a line is made of where nothing else is in it.
BLANK = r"^\s*$"


def kind_of(path: str) -> str:
    """jsonl, json, parquet or unknown, by the ending of the name."""
    _, dot, ending = path.lower().rstrip("/").rpartition(".")
    return {"jsonl": "jsonl", "ndjson": "jsonl", "json": "json", "parquet": "parquet"}.get(ending if dot else "", "unknown")


def lines_of(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """file, line, text of each record: the lines of jsonl, or the elements of the one array (or the one object) of each json file."""
    if kind == "jsonl":
        return numbered_lines(spark, path)
    if kind != "json":
        raise ValueError("invalid_format")
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    document = F.try_parse_json("value")
    items = F.when(F.schema_of_variant(document).startswith("ARRAY"), F.transform(F.try_variant_get(document, "$", "array<variant>"), lambda x: F.to_json(x)))
    return whole.select("file", F.posexplode(F.coalesce(items, F.array("value"))).alias("p", "text")).select("file", (F.col("p") + 1).cast("bigint").alias("line"), "text")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, blank lines counted), text of each line of the text files under path.

    A file's blocks are numbered by how many lines the blocks before them have; only block counts are exchanged.
    """
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    rows = spark.read.text(path).select(*block, F.monotonically_increasing_id().alias("p"), F.col("value").alias("text"))
    sizes = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file", "block", "first", before.alias("before"))
    return rows.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("p") - F.col("first") + 1).alias("line"), "text")


def checked(lines: DataFrame, dimension: int, strict: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """line, text, id, values, metadata, reason (null for good records) and the columns to keep; lines has line and text.

    The reasons are tried in a fixed order.  Without strict, booleans count as
    numbers, and ids of any length and values of any magnitude are good.
    """
    doc = F.try_parse_json("text")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    identifier = F.try_variant_get(doc, "$.id", "string")
    items = F.try_variant_get(doc, "$.values", "array<variant>")
    values = F.try_variant_get(doc, "$.values", "array<double>")
    numbers = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$" if strict else "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$"
    listed = F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x).rlike(numbers), F.lit(False)))
    metadata = F.coalesce(kind("$.metadata"), F.lit("VOID"))
    checks = [
        (doc.isNull(), "invalid_json", True),
        (~F.schema_of_variant(doc).startswith("OBJECT"), "not_object", True),
        (~F.coalesce(kind("$.id") == "STRING", F.lit(False)) | (F.char_length(identifier) == 0), "invalid_id", True),
        (F.char_length(identifier) > LONGEST_ID, "id_too_long", strict),
        (~F.coalesce(listed, F.lit(False)), "invalid_values", True),
        (F.size(items) != dimension, "dimension_mismatch", True),
        (~F.coalesce(F.forall(values, lambda x: F.abs(x) <= LARGEST), F.lit(False)), "out_of_range", strict),
        ((metadata != "VOID") & ~metadata.startswith("OBJECT"), "invalid_metadata", True),
    ]
    reason = F.coalesce(*[F.when(bad, name) for bad, name, used in checks if used])
    return lines.where(~F.col("text").rlike(BLANK)).select("line", "text", identifier.alias("id"), values.cast("array<float>").alias("values"), F.to_json(F.try_variant_get(doc, "$.metadata", "variant")).alias("metadata"), reason.alias("reason"), *keep)


def rejected(rows: DataFrame, longest: int) -> DataFrame:
    """line, text (cut where it is longer), reason of the bad records of checked lines."""
    text = F.when(F.length("text") > longest, F.concat(F.substring("text", 1, longest), F.lit("...[truncated]"))).otherwise(F.col("text"))
    return rows.where("reason is not null").select("line", text.alias("text"), "reason")


def outcome(rows: DataFrame, abort: bool, max_bad: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each of the columns by: processed, accepted, rejected, first_bad, failed."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"), F.min(F.when(F.col("reason").isNotNull(), F.col("line"))).alias("first_bad"))
    limit = F.lit(0) if abort else F.lit(max_bad if max_bad is not None else 2**62)
    return counts.withColumn("failed", F.col("rejected") > limit)
