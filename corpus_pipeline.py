"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  A stage's result is written and read again as
the next one's docs.

Results in odd cases: documents without text or letters go in the first stage;
rows with a null id pass the others as any row does, and as near copies stay
always, as no id can stand for them; of rows that repeat, one stays; a repeated id with different texts is two
documents to the second stage and one to the third; texts of any length count
whole; extra columns, whatever their names, are kept up to the last stage, which
returns its own; an empty table gives an empty result; without benchmark items
nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferrule.llm.bpe import bpe_round_trip, default_vocabulary
from ferrule.llm.common import documents, stored
from ferrule.llm.decontaminate import drop_contaminated
from ferrule.llm.exact_dedup import drop_copies
from ferrule.llm.jaccard_join import drop_near_copies
from ferrule.llm.language_id import drop_unknown, learn


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned."""
    return drop_unknown(docs, learn(docs))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id; the lower half of the ids is the indexed history."""
    from pyspark.sql import functions as F

    ends = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    return drop_copies(docs, F.col("id") <= (0 if ends["a"] is None else (ends["a"] + ends["b"]) // 2))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return drop_near_copies(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text."""
    return bpe_round_trip(docs, default_vocabulary())


STAGES = [("language", language), ("copies", copies), ("near_copies", near_copies), ("benchmark_free", benchmark_free), ("tokens", tokens)]

#: SQL has no byte-level BPE, no trained network and no search for contained passages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES):
        if number:
            docs = stored(docs, "stage")
        docs = stage(spark, docs, sf_dir)
    return docs
