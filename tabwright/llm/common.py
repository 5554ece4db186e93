"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import string
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tabwright.session import shared_folder


#: Spark's setting by which an execution's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def whole_text(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    This cuts the lineage: what an executor loses later is read again from the
    shared folder, not computed again. The write's shuffle files go with it
    instead of waiting for the driver's garbage collector.
    """
    folder = shared_folder(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        writer.parquet(folder)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of written tables that nothing reads any more; what was made of them is written too."""
    for table in tables:
        files = table.inputFiles()
        if files:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def with_columns(rows: DataFrame, work: Callable[..., list[list]], kept: list[str], read: list[Column], made: str) -> DataFrame:
    """``kept`` columns of ``rows`` as they are and the columns ``made``, worked out from the columns ``read``.

    ``work`` takes a list of values per column read and returns one per column
    made, batch by batch. It runs once per row: unlike a UDF, it is not worked
    out again for a filter on what it made.
    """
    fields = StructType.fromDDL(made)
    kinds, first, reads = [f.type for f in to_arrow_schema(fields)], len(kept), len(read)
    names = [*kept, *fields.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = work(*(batch.column(first + n).to_pylist() for n in range(reads)))
            columns = [*batch.columns[:first], *(pa.array(v, kind) for v, kind in zip(new, kinds))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = StructType([*(rows.schema[c] for c in kept), *fields])
    return rows.select(*kept, *(c.alias(f"read{n}") for n, c in enumerate(read))).mapInArrow(run, out)


class WordCache:
    """What was computed for recent words, in two generations of bounded size.

    When the young generation is full it becomes the old one; words met again
    are taken over, so that frequent words stay.
    """

    def __init__(self, size: int):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def turn(self) -> None:
        """Make room, where the young generation is full."""
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}

    def recall(self, word: str):
        """The old generation's entry, taken over, or None."""
        entry = self.old.get(word)
        if entry is not None:
            self.young[word] = entry
        return entry


def worker_cache(name: str, size: int) -> WordCache:
    """The cache of this name in this Python worker; the tasks that it runs one after another share it.

    A worker has one cache: asking for another name drops what earlier stages
    kept, so that a worker which lives through many stages holds one stage's words.
    """
    shelf = sys.modules.setdefault("_tabwright_caches", types.ModuleType("_tabwright_caches"))
    if getattr(shelf, "name", None) != name:
        shelf.name, shelf.cache = name, None
        gc.collect()
        shelf.cache = WordCache(size)
    return shelf.cache


def release() -> None:
    """Give back what this Python worker no longer uses.

    Workers outlive stages, so what an earlier stage cached or a large batch
    left free would stay beside what the executor needs later.
    """
    shelf = sys.modules.get("_tabwright_caches")
    if shelf is not None and getattr(shelf, "cache", None) is not None:
        shelf.name = shelf.cache = None
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library alone
    if trim is not None:
        trim(0)


def frugal(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that releases memory before the first and after the last."""

    def run(batches: Iterator) -> Iterator:
        release()
        yield from work(batches)
        release()

    return run
