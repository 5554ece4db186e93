"""Merkle fixity audit of WARC replicas.

Every record of a replica is hashed with its file and offset. Records of one
range of offsets form a node, neighbouring ranges form the nodes above, up to a
node per file; files are gathered by the leading digits of their names' hash up
to one root. Both replicas' trees are kept as tables. The audit compares the
roots and then, level by level, only the children of nodes that differ, until the
records that differ are found.

A node's hash covers its children in order. Node sizes are bounded: a range
holds at most as many offsets as it is long, other nodes at most ``FANOUT``
children, and records that claim the same offset are folded by sums.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwright.llm.common import written

RANGE_BYTES = 1 << 16
FANOUT = 16
#: Levels above the ranges, so that files of up to RANGE_BYTES * FANOUT ** FILE_LEVELS = 1 TB have one top node.
FILE_LEVELS = 6
#: Hex digits of a file name's hash that the nodes above the files share.
PREFIXES = (6, 4, 2, 0)
RECORDS_PER_FILE = 256
#: Bytes of a gzip member that are unpacked at once.
SLICE = 1 << 14
HEAD, BREAK = b"WARC/", b"\r\n\r\n"


def warc_record(url: Column, body: Column, record_id: Column) -> Column:
    """The bytes of a WARC response record; null parts count as empty."""
    text = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.encode(F.concat(head, text, F.lit("\r\n\r\n")), "UTF-8")


def lay_out(rows: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Rows (page_id, payload) as stored records: file, offset, page_id, payload.

    Files take a bounded number of rows in the order in which they were stored,
    whatever the ids are, and a record's offset is the sum of those before it.
    """
    placed = written(rows.withColumn("place", F.monotonically_increasing_id()), "records")
    file = F.format_string("part-%015d.warc", F.floor(F.col("place") / per_file))
    before = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sized = placed.select(file.alias("file"), "place", "page_id", F.octet_length("payload").alias("size"))
    offsets = sized.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))
    return placed.join(offsets.select("place", "file", "offset"), "place").select("file", "offset", "page_id", "payload")


def parse_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record bytes) of a WARC file, plain or with one gzip member per record; damage ends the file."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            # Fed in slices, a member costs its own bytes and at most one slice more, not the rest of the file.
            member, parts, here = zlib.decompressobj(31), [], at
            try:
                while not member.eof and here < len(data):
                    parts.append(member.decompress(data[here : here + SLICE]))
                    here += SLICE
            except zlib.error:
                pass
            if not member.eof:
                yield at, data[at:]
                return
            yield at, b"".join(parts)
            at = min(here, len(data)) - len(member.unused_data)
            continue
        end = data.find(BREAK, at)
        size = -1
        if data.startswith(HEAD, at) and end >= 0:
            for line in data[at:end].split(b"\r\n"):
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length" and value.strip().isdigit():
                    size = int(value)
        stop = end + len(BREAK) + size + len(BREAK)
        if size < 0 or stop > len(data):
            yield at, data[at:]
            return
        yield at, data[at:stop]
        at = stop


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, payload) of every record of WARC files; a file is one task's memory, as WARC files are cut for that.

    An empty file has no records; what is damaged or cut off is one record up to the file's end.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["file"], batch["content"]):
                found = list(parse_records(bytes(data)))
                yield pd.DataFrame({"file": name, "offset": [f[0] for f in found], "payload": [f[1] for f in found]})

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInPandas(run, "file string, offset long, payload binary")


def _leaves(records: DataFrame) -> DataFrame:
    """One row per file and offset; several records there are folded by sums of their hashes' words."""
    digest = F.sha2(F.coalesce("payload", F.lit(b"")), 256)
    rows = records.select(
        F.coalesce("file", F.lit("")).alias("name"), F.coalesce("offset", F.lit(-1)).alias("place"), digest.alias("digest"),
        F.octet_length(F.coalesce("payload", F.lit(b""))).cast("long").alias("size"),
    )
    words = [F.sum(F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long")) for k in range(8)]
    return rows.groupBy("name", "place").agg(
        F.sha2(F.concat_ws(",", F.count(F.lit(1)), *words), 256).alias("hash"), F.sum("size").alias("size"),
        F.count(F.lit(1)).alias("records"),
    )


def _above(nodes: DataFrame, name: Column, place: Column) -> DataFrame:
    """The parents of a level: their hash covers their children's in order."""
    children = F.transform(
        F.array_sort(F.collect_list(F.struct("name", "place", "hash"))),
        lambda c: F.concat_ws(":", c["name"], c["place"].cast("string"), c["hash"]),
    )
    return nodes.groupBy(name.alias("up_name"), place.alias("up_place")).agg(
        F.sha2(F.concat_ws("\n", children), 256).alias("hash")
    ).select(F.col("up_name").alias("name"), F.col("up_place").alias("place"), "hash")


def _steps() -> list[tuple[Column, Column]]:
    """How a node's parent is named, from the leaves to the root."""
    name, place = F.col("name"), F.col("place")
    steps = [(name, F.floor(place / RANGE_BYTES).cast("long"))]
    steps += [(name, F.floor(place / FANOUT).cast("long"))] * (FILE_LEVELS - 1)
    steps.append((name, F.lit(0).cast("long")))
    steps.append((F.substring(F.sha2(name, 256), 1, PREFIXES[0]), F.lit(0).cast("long")))
    steps += [(F.substring(name, 1, digits), F.lit(0).cast("long")) for digits in PREFIXES[1:]]
    return steps


def fixity_tree(records: DataFrame) -> list[DataFrame]:
    """The levels of a replica's tree, leaves first, each stored below the shared folder.

    ``records`` has file, offset and payload. Rows that repeat count as often as
    they are there; a null payload is an empty one; a null file or offset is a
    place of its own. An empty replica has no nodes.
    """
    levels = [written(_leaves(records), "leaves")]
    for name, place in _steps():
        levels.append(written(_above(levels[-1], name, place), "nodes"))
    return levels


def audit(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """(file, offset, status, left_size, right_size) of every place where two replicas differ.

    ``status`` is changed, missing (only left has it) or extra (only right has).
    Where the roots agree nothing below them is read.
    """
    suspects = None
    differing = None
    for depth in range(len(left) - 1, -1, -1):
        a, b = left[depth], right[depth]
        if suspects is not None:
            up_name, up_place = _steps()[depth]
            a, b = (
                side.withColumns({"up_name": up_name, "up_place": up_place})
                .join(suspects, ["up_name", "up_place"], "left_semi").drop("up_name", "up_place")
                for side in (a, b)
            )
        sizes = ["size"] if depth == 0 else []
        a = a.select("name", "place", F.col("hash").alias("left_hash"), *[F.col(s).alias(f"left_{s}") for s in sizes])
        b = b.select("name", "place", F.col("hash").alias("right_hash"), *[F.col(s).alias(f"right_{s}") for s in sizes])
        met = a.join(b, ["name", "place"], "full_outer").where(~F.col("left_hash").eqNullSafe(F.col("right_hash")))
        differing = written(met, "differing")
        if depth:
            suspects = differing.select(F.col("name").alias("up_name"), F.col("place").alias("up_place"))
            if differing.isEmpty():
                empty = left[0].limit(0)
                return empty.select(
                    F.col("name").alias("file"), F.col("place").alias("offset"), F.lit("changed").alias("status"),
                    F.col("size").alias("left_size"), F.col("size").alias("right_size"),
                )
    status = F.when(F.col("right_hash").isNull(), "missing").when(F.col("left_hash").isNull(), "extra").otherwise("changed")
    return differing.select(
        F.col("name").alias("file"), F.col("place").alias("offset"), status.alias("status"), "left_size", "right_size"
    )
