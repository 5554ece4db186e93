import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabwright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tabwright-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def text_table(spark):
    """Build an all-text table with a file-order column ``i`` from CSV-like text."""

    def build(text: str):
        lines = [line.split(",") for line in text.strip("\n").split("\n")]
        head, rows = lines[0], lines[1:]
        schema = "i long, " + ", ".join(f"`{h}` string" for h in head)
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)

    return build
