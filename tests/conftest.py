import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from breezeframe.session import build_session

    session = build_session(
        "tests", master="local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="6g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def series(spark):
    """Frame builder: rows of (station, 'HH:MM' or full time, seq, value)."""

    def build(rows, column="v"):
        rows = [(s, t if " " in t else f"2024-01-01 {t}:00", i, x) for s, t, i, x in rows]
        df = spark.createDataFrame(rows, f"station string, t string, seq bigint, {column} double")
        return df.selectExpr("station", "cast(t as timestamp) as time", "seq", column)

    return build
