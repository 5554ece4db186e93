"""Keyed state on streams: several micro-batches and restarts against the batch result."""

from tabwright.operators import catalog
from tabwright.streaming import state

SCHEMA = "id long, file string, file_hash string, at long"


def _arrive(spark, tmp_path, parts, mark):
    """Each part arrives and is worked off by a stream of its own that goes on from the checkpoint."""
    session = state.state_session(spark)
    folders = {n: str(tmp_path / n) for n in ("in", "out", "ck")}
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folders["in"])
        state.append_available(mark(session.readStream.schema(SCHEMA).parquet(folders["in"])), folders["out"], folders["ck"])
    return spark.read.parquet(folders["out"])


def test_versions_over_restarts_equal_the_batch(spark, tmp_path):
    rows = [(k, f"f{k % 3 if k % 5 else 0}", "h", 1000 - (k * 37) % 50 + k // 50 * 100) for k in range(150)]
    got = _arrive(spark, tmp_path, [rows[:50], rows[50:100], rows[100:]], lambda s: state.version_stream(s, "file", "at", "id"))
    whole = catalog.version_numbers(spark.createDataFrame(rows, SCHEMA), "file", "at", "id")
    pick = lambda df: sorted((r["id"], r["file"], r["version_number"]) for r in df.collect())
    assert pick(got) == pick(whole) and got.count() == 150


def test_duplicates_name_the_first_upload(spark, tmp_path):
    parts = [[(1, "a", "x", 5), (2, "b", "x", 3), (3, "c", "y", 4)], [(4, "d", "x", 9), (5, "e", None, 1)], [(6, "f", "y", 0), (7, "g", None, 2)]]
    got = _arrive(spark, tmp_path, parts, lambda s: state.mark_arrivals(s, "at", "id"))
    assert {r["id"]: (r["first_id"], r["is_duplicate"]) for r in got.collect()} == {
        1: ("2", True), 2: ("2", False), 3: ("3", False), 4: ("2", True), 5: ("5", False), 6: ("3", True), 7: ("5", True)
    }
