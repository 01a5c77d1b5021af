"""Joins, key-set operators, ordering and limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breezeframe.schema import KEYS, RAW_COLUMNS, SEQ, TIME


def join_outer(a: DataFrame, b: DataFrame, on: Sequence[str] = (*KEYS, TIME)) -> DataFrame:
    return a.join(b, list(on), "full_outer")


def join_inner(a: DataFrame, b: DataFrame, on: Sequence[str] = (*KEYS, TIME)) -> DataFrame:
    return a.join(b, list(on), "inner")


def merge_forecasts(
    weather: DataFrame,
    pollution: DataFrame,
    keys: Sequence[str] = KEYS,
    step: str = "step_hour",
    t: str = "target_time",
    hours: int = 72,
) -> DataFrame:
    """Weather forecast with the pollution values of the same step and hour, first ``hours`` steps."""
    on = [*keys, step, "_hour"]
    right = pollution.withColumn("_hour", F.date_trunc("hour", t)).drop(t)
    joined = weather.withColumn("_hour", F.date_trunc("hour", t)).join(right, on, "left")
    return first_n(joined.drop("_hour"), hours, keys, [step])


def forecast_offset(left: DataFrame, right: DataFrame, keys: Sequence[str], step: str, t: str) -> DataFrame:
    """Typical whole-hour offset per key over the steps both have, halves to even."""
    a = left.select(*keys, step, F.date_trunc("hour", t).alias("_l"))
    b = right.select(*keys, step, F.date_trunc("hour", t).alias("_r"))
    gap = (F.unix_seconds("_l") - F.unix_seconds("_r")) / 3600
    # whole-hour gaps: the exact percentile holds a handful of distinct values
    return a.join(b, [*keys, step]).groupBy(*keys).agg(
        F.bround(F.percentile(gap, 0.5)).cast("int").alias("offset_hours")
    )


def align_offset_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = KEYS,
    step: str = "step_hour",
    t: str = "target_time",
    hours: int = 72,
) -> DataFrame:
    """Shift the right side by its typical offset, then join; stations without overlap shift by 0."""
    offset = forecast_offset(left, right, keys, step, t)
    moved = right.join(offset, list(keys), "left").withColumn(
        t,
        F.date_trunc("hour", t) + F.make_interval(hours=F.coalesce("offset_hours", F.lit(0))),
    )
    return merge_forecasts(left, moved.drop("offset_hours"), keys, step, t, hours)


def semi_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_semi")


def only_new(new: DataFrame, existing: DataFrame, on: Sequence[str] = (*KEYS, TIME)) -> DataFrame:
    return new.join(existing.select(*on), list(on), "left_anti")


def with_scalar(df: DataFrame, values: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The columns of a one-row frame beside every row, as scalar subqueries."""
    return df.withColumns({c: values.select(c).scalar() for c in cols})


# --- sets ----------------------------------------------------------------------------


def union_history(old: DataFrame, new: DataFrame, cols: Sequence[str] = (*KEYS, TIME, SEQ, *RAW_COLUMNS)) -> DataFrame:
    """Stored raw columns plus new rows, matched by name; absent columns are null."""
    kept = old.select(*[c for c in cols if c in old.columns])
    return kept.unionByName(new, allowMissingColumns=True)


def distinct_rows(df: DataFrame, but: Sequence[str] = (SEQ,)) -> DataFrame:
    """Distinct full rows, the first stored copy kept; an ingest number is not part of the row."""
    order = [c for c in but if c in df.columns]
    by = [c for c in df.columns if c not in but]
    if not order:
        return df.distinct()
    return df.groupBy(*by).agg(*[F.min(c).alias(c) for c in order]).select(*df.columns)


def common_keys(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.select(*on).intersect(b.select(*on))


def missing_keys(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.select(*on).subtract(b.select(*on))


# --- order and limits ----------------------------------------------------------------


def sort_time(df: DataFrame, keys: Sequence[str] = KEYS, seq: str | None = SEQ) -> DataFrame:
    """Global order for a sink: a range-partitioned sort, nulls last."""
    order = [*keys, *[F.col(TIME).asc_nulls_last()], *([seq] if seq else [])]
    return df.orderBy(*order)


def _ranked(df: DataFrame, n: int, keys: Sequence[str], order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def first_n(df: DataFrame, n: int, keys: Sequence[str] = KEYS, order: Sequence[str] = (TIME, SEQ)) -> DataFrame:
    """First ``n`` rows per key. Spark keeps ``n`` per key and task before it shuffles."""
    return _ranked(df, n, keys, [F.col(c) for c in order])


def last_n(df: DataFrame, n: int, keys: Sequence[str] = KEYS, order: Sequence[str] = (TIME, SEQ)) -> DataFrame:
    return _ranked(df, n, keys, [F.col(c).desc() for c in order])


def sample_n(df: DataFrame, n: int, seed: int, key: Sequence[str] = (*KEYS, SEQ)) -> DataFrame:
    """``n`` rows by seeded hash of their key: the same rows on any partitioning."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *key, F.lit(str(seed)))), 1, 15), 16, 10).cast("bigint")
    return df.withColumn("_h", h).orderBy("_h", *key).limit(n).drop("_h")


