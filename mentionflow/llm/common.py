"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

T = TypeVar("T")

_WRITTEN: list[tuple[SparkSession, str]] = []


_KEPT: dict[object, object] = {}


def kept(key: object, make: Callable[[], T]) -> T:
    """What make() gives, kept in a worker for its next tasks until another key is asked for: operators that take turns in a worker don't add up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def give_back() -> None:
    """Returns to the system what the worker has freed, which the allocators else hold for the next task, of whatever operator."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a task's function, in a worker that holds little of earlier tasks and operators: what they kept() goes first, unless run keeps something itself."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _KEPT.clear()
        give_back()
        yield from run(batches)
        give_back()

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, which the session names; a temporary one only where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="mentionflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: later stages don't recompute it, and it outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mentionflow/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard() -> None:
    """Removes what materialize() has written; runs at exit too."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            jvm = spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended
            continue


atexit.register(discard)


def with_row(df: DataFrame, key: str, text: str, found: str, whole: bool) -> tuple[DataFrame, StructType]:
    """The rows' key and text, or with whole all their columns as the struct own, for parts(); and the schema of a map over them that gives the columns found instead of the text."""
    spark_type = StructType.fromDDL(found)
    given = df.select(F.struct(*df.columns).alias("own")) if whole else df.select(F.col(key), F.col(text).alias("_text"))
    own = [StructField("own", given.schema["own"].dataType)] if whole else []
    return given, StructType([StructField(key, df.schema[key].dataType), *own, *spark_type.fields])


def parts(batch: pa.RecordBatch, key: str, text: str, whole: bool, rows: int) -> Iterator[tuple[pa.Array, list[pa.Array]]]:
    """Of each so many rows of with_row()'s: the texts, and the columns that come before those found."""
    for start in range(0, batch.num_rows, rows):
        own = batch.slice(start, rows).columns
        if whole:
            yield own[0].field(text), [own[0].field(key), own[0]]
        else:
            yield own[1], own[:1]


#: A key that this share of the rows has is joined by broadcast; there are no more such keys than the share's inverse.
COMMON = 1e-3


def common_join(rows: DataFrame, found: DataFrame, key: str, often: str, total: int) -> DataFrame:
    """rows left-joined by key with found, which has one row a key and, in often, how many of the total rows have it. Null keys find nothing.

    Common keys are joined by broadcast and null ones not at all, so no task gets all rows of one key.
    """
    common = found.filter(F.col(often) >= max(1.0, COMMON * total))
    fields = [f for f in found.schema.fields if f.name != key]
    none = rows.filter(F.col(key).isNull()).select(*rows.columns, *(F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
    hot = rows.join(F.broadcast(common), key)
    rest = rows.filter(F.col(key).isNotNull()).join(F.broadcast(common.select(key)), key, "left_anti").join(found, key, "left")
    return none.unionByName(hot).unionByName(rest)


def bucket_of(key: Column, buckets: int) -> Column:
    """crc32 of the key as text, modulo buckets; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % buckets


def held_out(key: Column, buckets: int = 5, part: int = 0) -> Column:
    """Whether a row is kept from learning. A null key is neither held out nor learned from."""
    return F.coalesce(bucket_of(key, buckets) == part, F.lit(False))


def learns(key: Column, buckets: int = 5, part: int = 0) -> Column:
    return F.coalesce(bucket_of(key, buckets) != part, F.lit(False))
