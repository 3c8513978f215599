"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that Spark sends to a Python worker at a time. With rows alone, a batch of long texts could outgrow a worker.
ARROW_ROWS, ARROW_BYTES = 10_000, 16 << 20

def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless they are bounded tighter already."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        held = spark.conf.get(key, None) or ""
        if not (held.isdigit() and 0 < int(held) <= most):
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset on one machine, as in tests, a folder of that machine.

    On a cluster there is no such folder to fall back on, so this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cuewright/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and survives lost executors.

    With release, the shuffle files of finished steps, which nothing refers to any more, are cleaned up now
    rather than when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Remove tables that `written` returned, once no later plan reads them."""
    for df in tables:
        delete(df.sparkSession, df.scratch)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove every scratch table of this application, once no result that rests on them is needed."""
    delete(spark, f"{shared_dir(spark)}/cuewright/{spark.sparkContext.applicationId}")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; other columns can't clash with them."""
    return df.select(*(df[old].alias(new) for new, old in columns.items()))


def packets(batch: pa.RecordBatch, column: str, bytes_each: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about bytes_each bytes; a longer text is a slice of its own."""
    texts = batch.column(column)
    if len(texts) == 0:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > bytes_each:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, a null as an empty text."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings of bytes that stand one after another; ends begins with 0."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def run_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of runs that stand one after another; ends begins with 0."""
    before = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=before[1:])
    return before[ends[1:]] - before[ends[:-1]]


def joined(strings: pa.Array, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the chosen strings, one after another, and where each ends, after a 0."""
    taken = strings.take(pa.array(chosen))
    if not len(taken):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)
    return np.frombuffer(taken.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def released() -> None:
    """Give memory that Arrow and the C library keep for later back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such call in this C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, beginning and ending without what an earlier step or it has left in the worker: Spark keeps workers from one step to the next."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        yield from run(batches)
        released()

    return lean_run


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def spans_text(column: Column) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
