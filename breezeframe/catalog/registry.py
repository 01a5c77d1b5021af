"""Registration of queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breezeframe.fixtures import round6
from breezeframe.session import use_utc

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, dbl: str = ""):
    """Register ``fn(spark, sf_dir)``.

    ``dbl`` names the columns rounded to six digits, by the same rule on both sides.
    Timestamps leave as zone-free timestamps in UTC.
    """
    rounded = dbl.split()

    def wrap(fn):
        def run(spark, sf_dir) -> DataFrame:
            return present(fn(use_utc(spark), sf_dir), rounded)

        run.__name__ = fn.__name__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _rounded_sql(sql, rounded)
        return fn

    return wrap


def present(df: DataFrame, rounded: list[str]) -> DataFrame:
    types = dict(df.dtypes)
    missing = [c for c in rounded if c not in types]
    if missing:
        raise ValueError(f"no such columns to round: {missing}")
    return df.select(
        *[
            round6(F.col(c)).alias(c)
            if c in rounded
            else F.col(c).cast("timestamp_ntz").alias(c)
            if t == "timestamp"
            else F.col(c)
            for c, t in types.items()
        ]
    )


def _rounded_sql(sql: str, rounded: list[str]) -> str:
    if not rounded:
        return sql
    swaps = ", ".join(f"round({c} + 3.7e-9, 6) AS {c}" for c in rounded)
    return f"SELECT * REPLACE ({swaps}) FROM ({sql})"
