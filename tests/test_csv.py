import csv
import hashlib
import random

import pytest

from tabwright.sources import csv_records
from tabwright.operators import catalog
from tabwright.sources.csv_files import RAGGED_WARNING, ROW_INDEX, csv_summary, read_csv, stream_hashes


def load(spark, tmp_path, text, **options):
    path = tmp_path / "t.csv"
    path.write_text(text, encoding="utf-8")
    table = read_csv(spark, str(path), **options)
    rows = [tuple(r[h] for h in table.headers) for r in table.df.orderBy(ROW_INDEX).collect()]
    return table, rows


def test_ragged(spark, tmp_path):
    table, rows = load(spark, tmp_path, "tool\nspade\nfork,rake,hoe\n")
    assert table.headers == ["tool", "item_1", "item_2"] and table.warnings == [RAGGED_WARNING]
    assert rows == [("spade", "", ""), ("fork", "rake", "hoe")]
    assert tuple(csv_summary(table).first()) == (2, 3)


def test_extra_cells_ignored_without_widening(spark, tmp_path):
    table, rows = load(spark, tmp_path, "a,b\n1\n2,3,4\n", widen=False)
    assert table.headers == ["a", "b"] and rows == [("1", ""), ("2", "3")] and not table.warnings


def test_quotes_blank_headers_and_blank_rows(spark, tmp_path):
    text = '﻿ a ,,b\n"x, ""y""","line\nbreak",3\n , ,\n,,\nq,r\n'
    table, rows = load(spark, tmp_path, text)
    assert table.headers == ["a", "column_2", "b"]
    assert rows == [('x, "y"', "line\nbreak", "3"), ("q", "r", "")]
    assert [r[ROW_INDEX] for r in table.df.orderBy(ROW_INDEX).collect()] == [0, 1]


def test_quoted_ragged(spark, tmp_path):
    table, rows = load(spark, tmp_path, 'a,b\n"1,2",3,"4,5\n6",7\n')
    assert table.headers == ["a", "b", "item_1", "item_2"] and rows == [("1,2", "3", "4,5\n6", "7")]


def test_order_over_splits(spark, tmp_path):
    """Row numbers follow the file even when it is read in many splits."""
    lines = "\n".join(f"{i},{'x' * 50}" for i in range(1000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        table, rows = load(spark, tmp_path, f"k,v\n{lines}\n")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [int(r[0]) for r in rows] == list(range(1000))


@pytest.mark.parametrize("split", [150, 1 << 20])
def test_quoted_lines_over_many_splits(spark, tmp_path, split):
    """Ragged rows with quoted line breaks, whatever splits they are read in, as one sequential reader gives them."""
    rng = random.Random(6)
    signs = ["a", "é", ",", '"', "\n", "\r\n", "\r", " ", "bc"]
    rows = [["h1", "h2"]]
    for _ in range(40):
        rows.append(["".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 5, 30]))) for _ in range(rng.randint(1, 5))])
    for name, part in (("a.csv", rows[:25]), ("b.csv", rows[:1] + rows[25:])):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as file:
            csv.writer(file, lineterminator=rng.choice(["\n", "\r\n"])).writerows(part)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        table = read_csv(spark, str(tmp_path))
        got = [tuple(r) for r in table.df.orderBy(ROW_INDEX).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [tuple((r + [""] * 5)[:5]) for r in rows[1:] if any(c.strip() for c in r)]
    assert table.headers == ["h1", "h2", "item_1", "item_2", "item_3"]
    assert [r[1:] for r in got] == want and [r[0] for r in got] == list(range(len(want)))


def test_stray_quotes_and_open_cells():
    assert not csv_records.ends_inside(b'5" pipe,"x"y,3', False)
    assert csv_records.ends_inside(b'1,"a,""b', False) and csv_records.ends_inside(b'x,""y', True)
    assert not csv_records.ends_inside(b'b",c', True) and csv_records.ends_inside(b'b",c,"', True)
    assert csv_records.cells_in(b'"a,b",c,') == 3 and csv_records.cells_in(b'5" x,y') == 2
    assert csv_records.is_blank(b' ,"", \t') and not csv_records.is_blank(b'","') and not csv_records.is_blank(b'""""')


def test_a_cell_that_is_never_closed(spark, tmp_path):
    _, rows = load(spark, tmp_path, 'a,b\n1,2\n3,"x\ny\n')
    assert rows == [("1", "2"), ("3", "x\ny")]


def test_no_header(spark, tmp_path):
    with pytest.raises(ValueError, match="header"):
        load(spark, tmp_path, "")


def test_hashes_of_files_in_many_splits(spark, tmp_path):
    contents = {"a": b"\xef\xbb\xbfx,y\n1,2", "b": b"", "c": b"\n\n", "d": b"one\r\ntwo\r\n", "e": bytes(range(1, 256)) * 40,
                "f": b"\xef\xbb\xbf1\n", "g": b"no end"}
    for name, content in contents.items():
        (tmp_path / f"{name}.csv").write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        rows = stream_hashes(spark, str(tmp_path), "*.csv").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {r.path[-5]: (r.sha256, r.size_bytes) for r in rows}
    assert got == {n: (hashlib.sha256(c).hexdigest(), len(c)) for n, c in contents.items() if c}


def test_a_file_without_a_hash_is_not_removed(spark):
    kind = "path string, sha256 string, size_bytes long"
    now = spark.createDataFrame([("a", None, 9), ("b", "x", 1)], kind)
    manifest = spark.createDataFrame([("a", "h", 9), ("c", None, 1)], kind)
    states = {r.path: r.state for r in catalog.manifest_diff(now, manifest).collect()}
    assert states == {"a": "modified", "b": "new", "c": "removed"}
