"""Calendar, flag, power, interaction and wind expressions."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breezeframe.schema import (
    BASE_INTERACTIONS,
    COMPASS,
    DAY_HOURS,
    EXTRA_INTERACTIONS,
    POWERS,
    SEASON_MONTHS,
    SEQ,
    THRESHOLDS,
    TIME,
    WIND_HIGH_PM,
    WIND_LOW_PM,
)

TAU = 2 * math.pi


def flag(cond: Column) -> Column:
    """0/1 as bigint; a null comparison counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("bigint")


# --- calendar ------------------------------------------------------------------------


def _circle(name: str, part: Column, period: int) -> dict[str, Column]:
    angle = F.lit(TAU) * part / F.lit(float(period))
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def cyclic_time(df: DataFrame, time: str = TIME, mode: str = "observed") -> DataFrame:
    """Hour, day, month and weekday on the circle.

    ``observed`` puts the day of the month on 31 steps, ``forecast`` the day of the year
    on 365.
    """
    t = F.col(time)
    day = {"observed": (F.dayofmonth(t), 31), "forecast": (F.dayofyear(t), 365)}[mode]
    return df.withColumns({
        **_circle("hour", F.hour(t), 24),
        **_circle("day", *day),
        **_circle("month", F.month(t), 12),
        **_circle("day_of_week", F.weekday(t), 7),
    })


def time_flags(df: DataFrame, time: str = TIME) -> DataFrame:
    def within(c: Column, first: int, last: int) -> Column:
        return c.between(first, last) if first <= last else (c >= first) | (c <= last)

    spans = [(F.month(time), SEASON_MONTHS), (F.hour(time), DAY_HOURS)]
    return df.withColumns({name: flag(within(c, *span)) for c, table in spans for name, span in table.items()})


def time_key(time: str | Column = TIME) -> Column:
    t = F.col(time) if isinstance(time, str) else time
    return F.date_format(F.date_trunc("hour", t), "yyyy-MM-dd HH:mm:ss")


def epoch_to_ts(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def hour_keys(df: DataFrame, anchor: str, n: int, forward: bool = True) -> DataFrame:
    """The ``n`` hourly instants after (``forward``) or up to and including the anchor."""
    hour = F.date_trunc("hour", F.col(anchor))
    step = F.expr("interval 1 hour")
    span = F.expr(f"interval {n - 1} hours")
    keys = F.sequence(hour + step, hour + step + span, step) if forward else F.sequence(hour - span, hour, step)
    return df.withColumn("key_time", F.explode(keys)).withColumn("time_str", time_key("key_time"))


def local_label(time: Column, zone: str, pattern: str = "MMM dd, HH:mm") -> Column:
    return F.date_format(F.from_utc_timestamp(time, zone), pattern)


def positional_encoding(df: DataFrame, steps: int, h: str = "h") -> DataFrame:
    """One row per step 1..``steps`` with its place on the circle."""
    angle = F.lit(TAU) * F.col(h) / F.lit(float(steps))
    return df.withColumn(h, F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumns(
        {"pos_sin": F.sin(angle), "pos_cos": F.cos(angle)}
    )


# --- flags, powers, products ---------------------------------------------------------


def threshold_flags(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.withColumns({
        name: flag(F.col(c) > limit if op == ">" else F.col(c) < limit)
        for name, (c, op, limit) in THRESHOLDS.items()
        if c in have
    })


def powers(df: DataFrame) -> DataFrame:
    have = set(df.columns)

    def power(c: str, n: int) -> Column:
        out = F.col(c)
        for _ in range(n - 1):
            out = out * F.col(c)
        return out

    return df.withColumns({n: power(c, e) for n, (c, e) in POWERS.items() if c in have})


def interactions(df: DataFrame, pairs: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    pairs = {**BASE_INTERACTIONS, **EXTRA_INTERACTIONS} if pairs is None else pairs
    have = set(df.columns)
    return df.withColumns({
        name: F.col(a) * F.col(b) for name, (a, b) in pairs.items() if a in have and b in have
    })


def pm_weather_pairs(pms: Sequence[str], weather: Sequence[str]) -> dict[str, tuple[str, str]]:
    return {f"{p}_{w}_interaction": (p, w) for p in pms for w in weather}


# --- wind ----------------------------------------------------------------------------


def wind_vector(df: DataFrame, degrees: str = "wind_direction") -> DataFrame:
    """Sine and cosine of the direction, cut to ten digits."""
    rad = F.radians(F.col(degrees))
    return df.withColumns({
        "wind_direction_sin": F.bround(F.sin(rad), 10),
        "wind_direction_cos": F.bround(F.cos(rad), 10),
    })


def wind_source_flags(df: DataFrame) -> DataFrame:
    s, c = F.col("wind_direction_sin"), F.col("wind_direction_cos")
    return df.withColumns({
        "is_wind_from_high_pm": flag((s > WIND_HIGH_PM[0]) | ((s > WIND_HIGH_PM[1]) & (c > WIND_HIGH_PM[1]))),
        "is_wind_from_low_pm": flag((s < WIND_LOW_PM) | (c < WIND_LOW_PM)),
    })


def cardinal(degrees: Column) -> Column:
    """Sixteen-point compass name; Unknown for null."""
    idx = F.floor((degrees + 11.25) / 22.5).cast("int") % 16
    names = F.array(*[F.lit(n) for n in COMPASS])
    return F.coalesce(F.get(names, idx), F.lit("Unknown"))


def cardinal_angle(name: Column) -> Column:
    """Compass name to radians; 0 for unknown names."""
    table = F.create_map(*[F.lit(x) for i, n in enumerate(COMPASS) for x in (n, 22.5 * i)])
    return F.radians(F.coalesce(F.try_element_at(table, name), F.lit(0.0)))


# --- cleaning expressions ------------------------------------------------------------


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def finite_or_zero(c: Column) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


def log_transform(c: Column) -> Column:
    return F.log1p(c)


# --- labels --------------------------------------------------------------------------


def tiered(value: Column, steps: Sequence[tuple[float, str]], last: str) -> Column:
    """First label whose limit the value exceeds; null stays null."""
    chain = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, label in steps:
        chain = chain.when(value > limit, F.lit(label))
    return chain.otherwise(F.lit(last))


def strength_label(r: Column) -> Column:
    return tiered(F.abs(r), [(0.5, "STRONG"), (0.3, "MODERATE"), (0.1, "WEAK")], "NEGLIGIBLE")


def predictor_label(r: Column) -> Column:
    return tiered(
        F.abs(r), [(0.5, "STRONG"), (0.3, "MODERATE"), (0.2, "WEAK"), (0.1, "MINIMAL")], "NEGLIGIBLE"
    )


def predictability_label(r: Column) -> Column:
    return tiered(
        F.abs(r), [(0.7, "Excellent"), (0.5, "Good"), (0.3, "Moderate"), (0.1, "Weak")], "Very Weak"
    )


def horizon_label(h: Column) -> Column:
    """``6h``, ``1d``, ``1d12h``."""
    days, rest = F.floor(h / 24).cast("string"), (h % 24)
    return (
        F.when(h < 24, F.concat(h.cast("string"), F.lit("h")))
        .when(rest == 0, F.concat(days, F.lit("d")))
        .otherwise(F.concat(days, F.lit("d"), rest.cast("string"), F.lit("h")))
    )


def label_encode(df: DataFrame, column: str, out: str, time: str = TIME, seq: str = SEQ) -> DataFrame:
    """Integer codes in first-seen order.

    The distinct labels are aggregated first. They may be many, so they are numbered within
    days of their first sight; only the number of new labels per day is summed up over all.
    """
    first = df.groupBy(column).agg(F.min(F.struct(time, seq)).alias("_first"))
    first = first.withColumn("_day", F.to_date(f"_first.{time}"))
    days = first.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select("_day", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_day").orderBy("_first", column))
    codes = first.withColumn("_within", within).join(days, first["_day"].eqNullSafe(days["_day"])).select(
        column, (F.col("_before") + F.col("_within") - 1).cast("int").alias(out)
    )
    return df.join(codes, df[column].eqNullSafe(codes[column]), "left").drop(codes[column])


# --- names ---------------------------------------------------------------------------


def base_from_template(template: str) -> str:
    """``x_target_{h}h``, ``x_target_hh`` or ``x_target_<n>h`` to ``x``."""
    hit = re.fullmatch(r"(?s)(.*)_target_[^_]*h", template)
    return hit.group(1) if hit else template


def split_interaction(name: str) -> tuple[str, ...]:
    """Columns whose product the interaction column is; empty when unknown."""
    known = {**BASE_INTERACTIONS, **EXTRA_INTERACTIONS}
    if name in known:
        return known[name]
    for pm in ("pm2_5", "pm10"):
        hit = re.fullmatch(rf"{pm}_(.+)_interaction", name)
        if hit:
            return (pm, hit.group(1))
    return ()


