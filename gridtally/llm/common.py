"""Small helpers shared by the operators: durable intermediate tables and text access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver can read and write.

    A cluster names it in spark.checkpoint.dir.  Only where all runs in one
    process, as in tests, a temporary folder may stand in for it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gridtally-"))
    return context.getCheckpointDir()


#: Paths of the tables written inside the scratch() blocks that are open, innermost last.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


def stored(df: DataFrame, name: str, outlive: bool = False, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here.

    A lost executor then costs the tasks it was running, not the whole plan.
    With outlive the table outlives the innermost scratch() block.  options are the writer's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    blocks = _written.get()[: -1 if outlive else None]
    if blocks:
        blocks[-1].append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end the tables that stored() wrote inside; no plan may read them later."""
    token = _written.set((*_written.get(), []))
    try:
        yield
    finally:
        for path in _written.get()[-1]:
            _delete(spark, path)
        _written.reset(token)


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote, where no plan reads them any more."""
    for df in tables:
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            _delete(df.sparkSession, folder)


@contextmanager
def shuffles_cleaned(spark: SparkSession):
    """Inside, a written table's shuffle files go when it is written, and not some time later."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def unused(df: DataFrame, name: str) -> str:
    """name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's columns, but for maps: an order that reruns repeat."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()))


def release_memory() -> None:
    """Give a worker's free memory back: it lives on, and the next operator runs beside it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def text_slices(batches, column: str = "text", most_bytes: int = 2 << 20):
    """Arrow batches cut so that column holds about most_bytes in each, one row at least.

    A worker then holds the objects of one slice only, and hands results back
    as it goes.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = pc.cumulative_sum(sizes.cast("int64")).to_numpy()
        a = 0
        while a < batch.num_rows:
            start = ends[a - 1] if a else 0
            b = max(a + 1, int(ends.searchsorted(start + most_bytes, side="right")))
            yield batch.slice(a, b - a)
            a = b
    release_memory()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
