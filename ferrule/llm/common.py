"""What the corpus operators share: scratch tables, input columns, Python workers."""

from __future__ import annotations

import gc
import pickle
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Workers get this package's functions inside the task, so that no executor needs it installed.
cloudpickle.register_pickle_by_value(sys.modules["ferrule.llm"])

#: Rows and bytes of one Arrow batch sent to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Rows that the Parquet reader holds at once; texts can be long.
READER_ROWS = 512
#: Files of a narrow table for each core at most: small files cost more than they spread.
FILES_PER_CORE = 4


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, whatever the length of the texts.

    These are settings of the session: Spark reads them when a plan is made, which may be after the operator has returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READER_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/ferrule-scratch"
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it again; this cuts the lineage.

    A narrow table has rows of a few numbers that are made on the JVM; it is written in no more than FILES_PER_CORE files for each core.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if narrow:
        df = df.coalesce(FILES_PER_CORE * max(2, spark.sparkContext.defaultParallelism))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


class Shared:
    """A broadcast object of this package's classes, which executors need not have installed."""

    def __init__(self, spark: SparkSession, thing: object):
        self.held = spark.sparkContext.broadcast(cloudpickle.dumps(thing))

    @property
    def value(self):
        return pickle.loads(self.held.value)


class Scratch:
    """The stored() tables of one operator, deleted together when it needs them no more."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
        self.held.append(stored(df, name, narrow))
        return self.held[-1]

    def drop(self, *tables: DataFrame) -> None:
        """Some of them, or all that are left."""
        for df in [df for df in self.held if not tables or any(df is t for t in tables)]:
            forget(df)
            self.held = [x for x in self.held if x is not df]


def forget(df: DataFrame) -> None:
    """Delete the files of a stored() table that nothing reads any more."""
    forget_path(df.sparkSession, df._scratch)


def forget_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> DataFrame:
    """mapInArrow with a function that is made once for each task."""
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            out = step(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """The name, made longer until the table has no such column."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def doc_crc(column: str = "doc_id"):
    """crc32 of the id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that were stored and are not referred to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def thinned(df: DataFrame, order: str, size: int) -> DataFrame:
    """Rows of which the size smallest by a 64-bit hash column are certainly part, and about twice as many at most.

    Only counts come to the driver, so what a task sends there doesn't grow with the number of tasks.
    """
    share = 2.0 * size / max(1, df.count())
    return df if share >= 1 else df.where(F.col(order) < F.lit(int(-(1 << 63) + share * (1 << 64))))


def kept(name: str, make: Callable, mark: object = None):
    """An object that a Python worker makes once and keeps for the tasks that it runs later, until one of the same name has another mark."""
    state = vars(sys.modules.setdefault("ferrule_worker_state", types.ModuleType("ferrule_worker_state")))
    if name not in state or state[name][0] != mark:
        state[name] = mark, make()
    return state[name][1]
