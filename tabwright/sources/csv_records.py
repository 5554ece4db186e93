"""Records of quoted, multi-line CSV files, cut in parallel.

Spark hands out a file in splits of whole lines, and a line may stand inside a
quoted cell that began splits before. So the first scan follows every split
under both assumptions, that it begins outside and inside a quoted cell, and
notes how it would end. A prefix combine over the splits of a file (one row per
split) tells which assumption holds. The second scan cuts records at true line
ends, numbers them within their split and writes them; the parts of a record
that reaches over splits are put together by the split it began in. Counts per
split then give the numbers of all rows: nothing is sorted and no range shuffle
is needed.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.functions.cells import WHITESPACE
from tabwright.session import shared_folder

#: Splits up to which their states are broadcast (about 200 bytes each); more are joined by a shuffle.
BROADCAST_SPLITS = 50_000
#: A row of cells of which the last is quoted and not closed.
OPEN_CELL = re.compile(rb'(?:"(?:[^"]|"")*+"(?!")[^,]*,|[^",][^,]*,|,)*+"(?:[^"]|"")*+\Z')
CELL = re.compile(rb'(?:"(?:[^"]|"")*+"?[^,]*|[^,]*)(?:,|\Z)')
#: Bytes of which one tells that a record is not blank; others need a closer look.
SOLID = re.compile(rb'[^\t-\r\x1c-\x20,"\x80-\xff]')
LOST_SPLITS = "the splits of the file changed between two scans"


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted cell is still open behind the line; an open one before it is like a quote in front."""
    if b'"' not in line:
        return inside
    return OPEN_CELL.match(b'"' + line if inside else line) is not None


def units(line: bytes) -> list[tuple[bytes, bytes]]:
    """A line (ended by a line feed) as the rows that carriage returns part, each with its line end."""
    if b"\r" not in line:
        return [(line, b"\n")]
    parts = line.split(b"\r")
    crlf = len(parts) > 1 and not parts[-1]
    if crlf:
        parts.pop()
    return [*((p, b"\r") for p in parts[:-1]), (parts[-1], b"\r\n" if crlf else b"\n")]


def cells_in(record: bytes) -> int:
    if b'"' not in record:
        return record.count(b",") + 1
    at, n = 0, 0
    while True:
        found = CELL.match(record, at)
        n += 1
        if found.end() == len(record) and not found.group().endswith(b","):
            return n
        at = found.end()
        if at == len(record):
            return n + 1


def is_blank(record: bytes) -> bool:
    """Whether all cells are white space."""
    if SOLID.search(record):
        return False
    rows = csv.reader(io.StringIO(record.decode("utf-8", "replace"), newline=""))
    return all(not cell.strip(WHITESPACE) for row in rows for cell in row)


class Cutter:
    """Cuts the lines of one split into records, given whether it begins inside a quoted cell."""

    def __init__(self, inside: bool):
        self.inside = self.leads = inside
        self.held: list[bytes] = []
        self.kept = self.lines = 0

    def take(self, line: bytes) -> Iterator[tuple[str, int, bytes]]:
        """(kind, number, text) of what ends in this line: a ``record`` or the ``end`` of an earlier split's record."""
        self.lines += 1
        for text, stop in units(line):
            self.inside = ends_inside(text, self.inside)
            self.held.append(text + stop if self.inside else text)
            if self.inside:
                continue
            whole, self.held = b"".join(self.held), []
            if self.leads:
                self.leads = False
                yield "end", -1, whole
            elif not is_blank(whole):
                yield "record", self.kept, whole
                self.kept += 1

    def rest(self) -> Iterator[tuple[str, int, bytes]]:
        """What the split leaves open: the ``start`` of a record, or nothing but the ``middle`` of an earlier one."""
        if self.held:
            yield "middle" if self.leads else "start", -1, b"".join(self.held)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"),
    )


FACTS = "file string, start long, lines long, if_outside boolean, if_inside boolean, breaks boolean"


def _split_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per split its lines, whether it ends inside a quoted cell under either assumption, and whether a record ends
    in it if it begins inside one; lines without quotes come as null."""
    columns = ["file", "start", "lines", "if_outside", "if_inside", "breaks"]
    split, facts = None, [0, False, True, False]
    for batch in batches:
        done = []
        for file, start, line in zip(batch["file"], batch["start"], batch["line"]):
            if (file, start) != split:
                if split:
                    done.append((*split, *facts))
                split, facts = (file, start), [0, False, True, False]
            facts[0] += 1
            if line is not None:
                for text, _ in units(line):
                    facts[1:3] = ends_inside(text, facts[1]), ends_inside(text, facts[2])
                    facts[3] |= not facts[2]
        yield pd.DataFrame(done, columns=columns)
    if split:
        yield pd.DataFrame([(*split, *facts)], columns=columns)


def _combine(splits: pd.DataFrame) -> pd.DataFrame:
    """Of a file's splits: whether each begins inside a quoted cell, and the split in which that cell's record began."""
    inside, head, rows = False, -1, []
    for s in splits.sort_values("start").itertuples(index=False):
        rows.append((s.file, s.start, s.lines, inside, head))
        if not inside or s.breaks:
            head = s.start  # of the record that is open at the end, if any
        inside = s.if_inside if inside else s.if_outside
    return pd.DataFrame(rows, columns=["of", "at", "expected", "inside", "head"])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file", "start", "head", "kind", "number", "width", "text"]
    split, cutter, expected, head = None, None, 0, -1

    def rows(found):
        for kind, number, text in found:
            own = split[1] if kind in ("record", "start") else head
            yield (*split, own, kind, number, cells_in(text) if kind == "record" else 0, text)

    def close():
        if cutter.lines != expected:
            raise ValueError(LOST_SPLITS)
        return rows(cutter.rest())

    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if (r.file, r.start) != split:
                if split:
                    out += close()
                split, cutter, expected, head = (r.file, r.start), Cutter(r.inside), r.expected, r.head
            out += rows(cutter.take(r.line))
        yield pd.DataFrame(out, columns=columns)
    if split:
        yield pd.DataFrame(list(close()), columns=columns)


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records that reach over splits, from their parts in order; blank ones go."""
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            text = b"".join(r.parts)
            # A record that the file leaves open ends with the file's last line.
            text = text if r.closed else text.removesuffix(b"\n")
            if not is_blank(text):
                out.append((r.file, r.start, 1 << 40, cells_in(text), text))
        yield pd.DataFrame(out, columns=["file", "start", "number", "width", "text"])


def _stored(df: DataFrame, name: str) -> DataFrame:
    folder = shared_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, row_number, width, record): the records of all files that hold more than white space.

    ``position`` counts from 0 within a file (its header is 0), ``row_number``
    the records behind the headers from 0 over all files in the order of their
    paths. ``record`` is the raw text without its line end; line ends are LF,
    CR LF and CR, and are part of the record inside quotes. Quotes count where
    they begin a cell; a cell that is never closed ends with its file.
    """
    quoted = F.when(F.contains("line", F.lit(b'"')), F.col("line"))
    lines = _lines(spark, path)
    ends = lines.select("file", "start", quoted.alias("line")).mapInPandas(
        _split_ends, FACTS
    )
    states = _stored(ends, "splits").groupBy("file").applyInPandas(
        _combine, "of string, at long, expected long, inside boolean, head long"
    )
    states = _stored(states, "states")
    same = (F.col("file") == F.col("of")) & (F.col("start") == F.col("at"))
    if states.count() <= BROADCAST_SPLITS:
        told = lines.join(F.broadcast(states), same)
    else:
        # A shuffle by split keeps a split in one task; its lines are put in order there.
        told = lines.withColumn("line_number", F.monotonically_increasing_id()).join(states.hint("merge"), same)
        told = told.sortWithinPartitions("file", "start", "line_number")
    cut = _stored(
        told.select("file", "start", "line", "inside", "expected", "head").mapInPandas(
            _cut, "file string, start long, head long, kind string, number long, width int, text binary"
        ), "records",
    )
    whole = cut.where(F.col("kind") == "record").select("file", "start", "number", "width", "text")
    parts = cut.where(F.col("kind") != "record").groupBy("file", F.col("head").alias("start")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]).alias("parts"),
        F.max(F.col("kind") == "end").alias("closed"),
    )
    over = parts.mapInPandas(_joined, "file string, start long, number long, width int, text binary")
    records = whole.unionByName(_stored(over, "joined"))
    before = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    # A record that reaches on is its split's last.
    own = F.count_if(F.col("number") < 1 << 40)
    splits = records.groupBy(F.col("file").alias("of"), F.col("start").alias("at")).agg(
        F.count(F.lit(1)).alias("n"), own.alias("own")
    )
    files = splits.groupBy("of").agg((F.sum("n") - 1).alias("rows"))
    files = files.select(F.col("of").alias("name"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"))
    offsets = splits.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).join(files, F.col("of") == F.col("name"))
    offsets = _stored(offsets.select("of", "at", "own", "offset", "base"), "offsets")
    position = F.col("offset") + F.least("number", "own")
    return records.join(offsets, same).select(
        "file", position.alias("position"), (F.col("base") + position - 1).alias("row_number"), "width",
        F.col("text").cast("string").alias("record"),
    )
