"""Shared helpers: the work folder, staged tables, fresh column names, byte-bounded batches, memory given back."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that a Python step holds as arrays at a time, unless one row alone is longer.
CHUNK_BYTES = 1 << 20


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); a local one only where master is local and none is set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or "file:///tmp/checkpoints").rstrip("/")


class Scope:
    """The folders that were staged for one result.  Deleting them touches no other result's."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def new_folder(self, name: str) -> str:
        path = f"{work_dir(self.spark)}/korvid/{name}-{uuid.uuid4().hex}"
        self.folders.append(path)
        # Whatever nobody has deleted goes when the application ends.
        fs, p = self._at(path)
        fs.deleteOnExit(p)
        return path

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def delete(self) -> None:
        """To be called once what was built on the folders has been written: it is read again if an executor is lost."""
        while self.folders:
            fs, p = self._at(self.folders.pop())
            fs.delete(p, True)


_scope: ContextVar[Scope | None] = ContextVar("korvid-scope", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Folders staged inside belong to the yielded scope, which the caller deletes."""
    own = Scope(spark)
    mark = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(mark)


def new_folder(spark: SparkSession, name: str) -> str:
    return (_scope.get() or Scope(spark)).new_folder(name)


def owned(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query (spark, sf_dir) whose result has ``release()``: it deletes what was staged for it, once it is written."""

    @wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        with scope(spark) as own:
            out = query(spark, *args)
        out.release = own.delete
        return out

    return run


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: later jobs survive the loss of any executor without
    going back to the input, and a value computed once keeps its value.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the folders of staged tables that only tables already written were made from."""
    for f in frames:
        path = f.sparkSession._jvm.org.apache.hadoop.fs.Path(f.staged_at)
        path.getFileSystem(f.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that ``df`` does not have, whatever its letters' case."""
    taken, out = {c.lower() for c in df.columns}, []
    for b in bases:
        name, k = f"_kv_{b}", 0
        while name.lower() in taken:
            k += 1
            name = f"_kv_{b}_{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """Return what this process has freed to the system: Arrow's pool and the C heap keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow that gives memory back after each batch and at the end.

    Spark keeps Python workers between tasks and stages, beside the JVM in the
    same memory; what the largest batch took would stay with each of them.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            give_back()

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(each(batches))
        finally:
            give_back()

    return freed


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``limit`` bytes in ``column``; a longer row comes alone."""
    sizes = batch.column(column)
    n, start, held = batch.num_rows, 0, 0
    lengths = [len(x) if x is not None else 0 for x in _buffers(sizes)]
    for i in range(n):
        if held and held + lengths[i] > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += lengths[i]
    if start < n:
        yield batch.slice(start, n - start)


def _buffers(col: pa.Array) -> Iterable:
    return (x.as_buffer() if x.is_valid else None for x in col)


def text_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in col]
