"""Shared helpers of the training-data operators: durable intermediate tables and Arrow batches.

Rules that hold for every operator here:

* a null text is an empty text; extra columns are ignored (each operator selects what it reads);
* a null id is an id like any other: it sorts before all others and joins with itself;
* rows that repeat an id are separate documents.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into arrays at once.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch between the JVM and a worker (one row at least).
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


@functools.cache
def _c_library():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def tidy(run: Callable) -> Callable:
    """``run`` for mapInArrow, after which the worker, which Spark uses again, hands its free memory back."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(_c_library(), "malloc_trim"):
                _c_library().malloc_trim(0)

    return tidied


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine, as in tests, a temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidelog-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, lineage cut, no executor needed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() wrote of these tables: only once nothing that is still to be computed reads them."""
    for df in tables:
        for name in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name.rsplit("/", 1)[0])
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, not only by rows, unless the session has a smaller bound."""
    now = (spark.conf.get(BATCH_SETTING, None) or "").removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column's UTF-8 bytes; null becomes empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        sizes = [x or 0 for x in pa.compute.binary_length(batch.column(batch.schema.get_field_index(name))).to_pylist()]
        start = total = 0
        for row, size in enumerate(sizes):
            if row > start and total + size > limit:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, schema.types)], schema=schema)


def same_key(left, right):
    """Null-safe equality of two columns, for joins on ids that may be null."""
    return left.eqNullSafe(right)


def doc_rows(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator reads, by name."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
