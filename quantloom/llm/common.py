"""What the text operators share: table access, written intermediates and what becomes of them."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Python code turns into objects at once; rows of an Arrow batch of a written step, which Spark bounds in bytes
#: besides.
SLICE, ARROW_ROWS = 500, 1000
#: Bytes of input for which a coalesced step has one task.
PART_BYTES = 4 << 20
#: The white space of the contracts, as a Java class body: space and tab to carriage return.
SPACE = "\\x20\\x09-\\x0D"

_scopes: list[list[tuple[SparkSession, str]]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, a null read as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def slices(frames: Iterator, rows: int = SLICE) -> Iterator:
    """The same rows in frames or record batches of at most `rows`."""
    for frame in frames:
        n = len(frame) if hasattr(frame, "iloc") else frame.num_rows
        for at in range(0, n, rows):
            yield frame.iloc[at : at + rows] if hasattr(frame, "iloc") else frame.slice(at, rows)
        pa.default_memory_pool().release_unused()  # workers are kept for later stages


def _shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. A local master's threads share the machine's folder for
    temporary files; any other master without spark.checkpoint.dir is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), "quantloom-checkpoints")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """What written() has put down inside goes at the end of the block: the block's result must be written elsewhere by
    then."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            remove(spark, path)


def written(df: DataFrame, label: str = "part", like: DataFrame | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage is cut, a lost executor costs nothing
    already written, and later plans see true sizes. The files go with the enclosing scratch(), or else when the
    driver's Python ends.

    like: a written table; df is then written by as many tasks as its size asks for (see sized)."""
    out, path = saved(sized(df, like) if like is not None else df, label)
    if _scopes:
        _scopes[-1].append((df.sparkSession, path))
    else:
        atexit.register(remove, df.sparkSession, path)
    return out


def saved(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The written table and its path, for the caller to remove()."""
    path = f"{_shared_dir(df.sparkSession)}/quantloom-{label}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """At most ARROW_ROWS rows in an Arrow batch for what runs inside; the session's own setting holds again after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sized(df: DataFrame, like: DataFrame) -> DataFrame:
    """df in one task for each PART_BYTES of the written table `like`, but two for each core at least. Shuffled partitions
    are put behind one another, not together, so a task's memory stays that of one; and each file costs the executor a few
    calls to the system."""
    spark = df.sparkSession
    size = int(str(like._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-size // PART_BYTES)))


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended before; nothing else depends on these files
        pass
