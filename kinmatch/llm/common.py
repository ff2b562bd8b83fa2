"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where an order or a join needs a value; it sorts last. A real id must not have this value.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(df: DataFrame, rows: int = 1000, size: str = "16m") -> DataFrame:
    """df; its session then hands Python so many rows or bytes at once at most, for texts can be long.

    The session keeps these two settings; every operator here that reads texts sets them.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def _made(cls: type, state: dict | None):
    out = cls.__new__(cls)
    if hasattr(out, "__setstate__"):
        out.__setstate__(state)
    else:
        out.__dict__.update(state or {})
    return out


class _Making:
    def __init__(self, cls: type, state: dict | None):
        self.parts = cls, state

    def __reduce__(self):
        return _made, self.parts


class ByValue:
    """Objects for broadcasts: pickled with their class, so that executors need no copy of this package."""

    def __reduce__(self):
        return cloudpickle.loads, (cloudpickle.dumps(_Making(type(self), self.__getstate__())),)


def released(run: Callable) -> Callable:
    """`run` for mapInArrow, whose freed memory goes back to the system at the task's end, as Python's workers live on."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage there."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Has the driver collect its garbage, whereupon Spark deletes the shuffle files and checkpoints that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_text() -> Column:
    """doc_id as text; a null counts as the empty text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def _keys() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))]


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id as k1 (NO_ID if null), the text's hash as k2, the text (null: empty), and what else is asked for.

    Rows that agree in doc_id and text share a key and get equal results.
    """
    k1, k2 = _keys()
    return bounded_batches(docs).select(k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def with_keys(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with keyed()'s two keys besides, and the names they have got."""
    names = [free_name(docs, "k1"), free_name(docs, "k2")]
    return docs.withColumns(dict(zip(names, _keys(), strict=True))), names


def broadcast_if_small(df: DataFrame, most: int) -> DataFrame:
    """df, marked for a broadcast if it has no more than so many rows. Counts it, so it should be checkpointed."""
    return F.broadcast(df) if df.count() <= most else df


def others(docs: DataFrame) -> Column:
    """All columns but the text, as one; column names may then be used that docs has too."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")


def free_name(docs: DataFrame, name: str) -> str:
    """The name, or one like it, that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def real_id(k1: str = "k1") -> Column:
    return F.when(F.col(k1) != NO_ID, F.col(k1)).alias("doc_id")


def byte_lists(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `most` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum([len(x) for x in byte_lists(batch.column(column))])
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def bucket_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions a key that repartition(n, key) sends there."""
    found: dict[int, int] = {}
    rows = spark.range(24 * n + 200).select(F.col("id").cast("int").alias("k")).select("k", F.expr(f"pmod(hash(k), {n})").alias("p")).collect()
    for k, p in rows:
        found.setdefault(p, k)
    return [found.get(p, p) for p in range(n)]
