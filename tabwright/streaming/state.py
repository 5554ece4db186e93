"""Keyed state on streams: version numbers per file, and duplicates reported with the upload that came first.

State lives in Spark's state store, so a stream that is stopped or loses an
executor goes on where its checkpoint stands. The rows of one key in one
micro-batch are put in order together; the source's limit per trigger bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_session(spark: SparkSession) -> SparkSession:
    """A session of its own whose streams keep their state in RocksDB, as keyed state asks."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return session


class _Versions(StatefulProcessor):
    """The number of events that a file has had; those of a micro-batch follow in time order."""

    def __init__(self, at: str, key: str):
        self.order = [at, key]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "number long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number = self.last.get()[0] if self.last.exists() else 0
        found = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        self.last.update((number + len(found),))
        yield found.assign(version_number=range(number + 1, number + len(found) + 1))

    def close(self) -> None:
        pass


class _Firsts(StatefulProcessor):
    """The first upload of a content."""

    def __init__(self, at: str, key: str):
        self.order = [at, key]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        known = self.first.exists()
        first = self.first.get()[0] if known else str(found[self.order[1]].iloc[0])
        if not known:
            self.first.update((first,))
        duplicate = [True] * len(found) if known else [False] + [True] * (len(found) - 1)
        yield found.assign(first_id=first, is_duplicate=duplicate)

    def close(self) -> None:
        pass


def _with_state(rows: DataFrame, by: str, processor: StatefulProcessor, added: str) -> DataFrame:
    out = T.StructType([*rows.schema, *T.StructType.fromDDL(added)])
    return rows.groupBy(by).transformWithStateInPandas(processor, out, "Append", "None")


def version_stream(events: DataFrame, file: str, at: str, key: str) -> DataFrame:
    """The events of a stream with ``version_number``: 1, 2, ... per file.

    Within a micro-batch events count in order of ``at`` and ``key``; an event
    that arrives in a later one follows those before it, as an appended version
    does. Needs a session like ``state_session``.
    """
    return _with_state(events, file, _Versions(at, key), "version_number long")


def mark_arrivals(files: DataFrame, at: str, key: str, file_hash: str = "file_hash") -> DataFrame:
    """The uploads of a stream with ``first_id`` (as text) and ``is_duplicate``.

    The first upload of a content stays known, however late a copy comes: the
    state grows by one id per content. Uploads without a hash are one content.
    Needs a session like ``state_session``.
    """
    return _with_state(files, file_hash, _Firsts(at, key), "first_id string, is_duplicate boolean")


def append_available(marked: DataFrame, out: str, checkpoint: str) -> None:
    """Run a stream over all that has arrived and append its rows to ``out``, each once."""
    marked.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(
        "append"
    ).trigger(availableNow=True).start().awaitTermination()
