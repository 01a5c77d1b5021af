"""Data-quality checks: counts and shares per key, and a score over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeframe.operators.aggregates import (
    contrast_means,
    count_if,
    duplicate_count,
    per_column,
    percent,
    rows,
)
from breezeframe.operators.quantiles import beside, exact_quantiles, wide_quantiles
from breezeframe.schema import CYCLIC_COLUMNS, FLAG_COLUMNS, KEYS, RANGE_RULES, TARGET_MEAN_LIMITS, TARGETS, TIME


def order_check(df: DataFrame, lo: str = "pm2_5", hi: str = "pm10", keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows whose lower quantity exceeds the upper one."""
    bad = F.col(lo) > F.col(hi)
    return df.groupBy(*keys).agg(
        count_if(bad).alias("violations"),
        percent(count_if(bad), rows()).alias("percent"),
        F.max(F.when(bad, F.col(lo) - F.col(hi))).alias("max_excess"),
    )


def range_check(
    df: DataFrame, rules: Mapping[str, tuple[float, float]] = RANGE_RULES, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Readings below and above each column's limits."""
    cols = [c for c in rules if c in df.columns]
    base = per_column(
        df.select(*keys, *[
            F.struct(F.col(c).alias("v"), (F.col(c) < rules[c][0]).alias("lo"), (F.col(c) > rules[c][1]).alias("hi")).alias(c)
            for c in cols
        ]),
        cols,
        {
            "below": lambda c: count_if(c["lo"]),
            "above": lambda c: count_if(c["hi"]),
            "min": lambda c: F.min(c["v"]),
            "max": lambda c: F.max(c["v"]),
        },
        keys,
    )
    return base.withColumn("violations", F.col("below") + F.col("above"))


def bounds_check(df: DataFrame, cols: Sequence[str] = CYCLIC_COLUMNS, tol: float = 1.01, keys: Sequence[str] = KEYS):
    """Sine and cosine columns outside ``[-tol, tol]``."""
    cols = [c for c in cols if c in df.columns]
    return range_check(df, {c: (-tol, tol) for c in cols}, keys)


def domain_check(
    df: DataFrame, cols: Sequence[str] = FLAG_COLUMNS, values: Sequence[int] = (0, 1), keys: Sequence[str] = KEYS
) -> DataFrame:
    """Rows of each flag outside its domain; a null is outside."""
    cols = [c for c in cols if c in df.columns]
    inside = lambda c: F.coalesce(c.isin(*values), F.lit(False))
    return per_column(
        df, cols, {"unexpected": lambda c: count_if(~inside(c)), "nulls": lambda c: count_if(c.isNull())}, keys
    )


def zscore_report(df: DataFrame, cols: Sequence[str], z: float = 3.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Readings more than ``z`` sample deviations from the mean."""
    stats = df.groupBy(*keys).agg(
        *[f(c).alias(f"{p}_{c}") for c in cols for p, f in (("_m", F.avg), ("_s", F.stddev_samp))]
    )
    names = [c for c in stats.columns if c not in keys]
    scored = beside(df.select(*keys, *cols), stats, keys, names).select(
        *keys, *[F.abs(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}"))).alias(c) for c in cols]
    )
    return per_column(
        scored, cols,
        {
            "outliers": lambda c: count_if(c > z),
            "percent": lambda c: percent(count_if(c > z), F.count(c)),
            "max_abs_z": F.max,
        },
        keys,
    )


def iqr_report(df: DataFrame, cols: Sequence[str], k: float = 1.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Readings strictly outside the quartile fences, each column on its own."""
    q = wide_quantiles(exact_quantiles(df, cols, [0.25, 0.75], keys), [0.25, 0.75], ["q1", "q3"], keys)
    wide = q.groupBy(*keys).agg(*[
        F.max(F.when(F.col("column") == c, F.struct("q1", "q3"))).alias(f"_q_{c}") for c in cols
    ])
    joined = beside(df.select(*keys, *cols), wide, keys, [f"_q_{c}" for c in cols])

    def fence(c: str) -> Column:
        q1, q3 = F.col(f"_q_{c}.q1"), F.col(f"_q_{c}.q3")
        lo, hi = q1 - (q3 - q1) * k, q3 + (q3 - q1) * k
        v = F.col(c)
        return F.struct(v.alias("v"), ((v < lo) | (v > hi)).alias("out"), lo.alias("lo"), hi.alias("hi")).alias(c)

    return per_column(
        joined.select(*keys, *[fence(c) for c in cols]), cols,
        {
            "outliers": lambda c: count_if(c["out"]),
            "percent": lambda c: percent(count_if(c["out"]), F.count(c["v"])),
            "lower_fence": lambda c: F.max(c["lo"]),
            "upper_fence": lambda c: F.max(c["hi"]),
        },
        keys,
    )


def quality_score(
    df: DataFrame,
    cols: Sequence[str],
    outlier_cols: Sequence[str],
    duplicate_cols: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """100 minus weighted deductions for gaps, copies, range, domain, order and outliers.

    Two aggregate passes besides the quartiles and the copies: one counts what each row shows
    by itself, the second what lies outside the limits that follow from it.
    """
    cols, by = list(cols), list(keys)
    rules = {c: r for c, r in RANGE_RULES.items() if c in df.columns}
    cyclic = [c for c in CYCLIC_COLUMNS if c in df.columns]
    flags = [c for c in FLAG_COLUMNS if c in df.columns]
    bad = {
        "range_columns": [(F.col(c) < lo) | (F.col(c) > hi) for c, (lo, hi) in rules.items()],
        "cyclic_columns": [F.abs(c) > 1.01 for c in cyclic],
        "flag_columns": [~F.coalesce(F.col(c).isin(0, 1), F.lit(False)) for c in flags],
    }
    crossed = F.col("pm2_5") > F.col("pm10")
    one = df.groupBy(*by).agg(
        rows().alias("_rows"),
        *[count_if(F.col(c).isNull()).alias(f"_n_{c}") for c in cols],
        *[F.max(F.coalesce(x, F.lit(False)).cast("int")).alias(f"_{name}_{i}") for name, xs in bad.items() for i, x in enumerate(xs)],
        percent(count_if(crossed), rows()).alias("order_percent"),
        *[f(c).alias(f"{p}_{c}") for c in outlier_cols for p, f in (("_m", F.avg), ("_s", F.stddev_samp))],
    )
    total = lambda names: sum((F.col(n) for n in names), F.lit(0).cast("bigint"))
    missing = percent(total([f"_n_{c}" for c in cols]), F.col("_rows") * len(cols))
    report = one.select(
        *by, missing.alias("missing_percent"), "order_percent",
        *[total([f"_{name}_{i}" for i in range(len(xs))]).alias(name) for name, xs in bad.items()],
    )
    q = wide_quantiles(exact_quantiles(df, outlier_cols, [0.25, 0.75], keys), [0.25, 0.75], ["q1", "q3"], keys)
    limits = q.groupBy(*by).agg(*[
        F.max(F.when(F.col("column") == c, F.struct("q1", "q3"))).alias(f"_q_{c}") for c in outlier_cols
    ]).join(one.select(*by, *[f"{p}_{c}" for c in outlier_cols for p in ("_m", "_s")]), by)
    names = [c for c in limits.columns if c not in by]
    beyond = beside(df.select(*by, *outlier_cols), limits, keys, names)

    def outside(c: str) -> tuple[Column, Column]:
        q1, q3 = F.col(f"_q_{c}.q1"), F.col(f"_q_{c}.q3")
        far = F.abs(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}"))) > 3.0
        return far, (F.col(c) < q1 - (q3 - q1) * 1.5) | (F.col(c) > q3 + (q3 - q1) * 1.5)

    seen = beyond.groupBy(*by).agg(*[
        (count_if(x) > 0).cast("bigint").alias(f"{p}_{c}") for c in outlier_cols for p, x in zip("zq", outside(c))
    ])
    seen = seen.select(
        *by, total([f"z_{c}" for c in outlier_cols]).alias("z_columns"), total([f"q_{c}" for c in outlier_cols]).alias("iqr_columns")
    )
    dup = duplicate_count(df, duplicate_cols or cols, keys).select(
        *by, percent(F.col("duplicates"), F.col("rows")).alias("duplicate_percent")
    )
    out = report.join(dup, by).join(seen, by)
    cap = lambda limit, c: F.least(F.lit(float(limit)), c)
    score = (
        F.lit(100.0)
        - cap(20, F.col("missing_percent") * 4)
        - cap(10, F.col("duplicate_percent") * 2)
        - F.col("range_columns") * 2
        - F.col("cyclic_columns") * 3
        - F.col("flag_columns") * 2
        - cap(15, F.col("order_percent") * 3)
        - cap(5, (F.col("z_columns") + F.col("iqr_columns")) * 0.5)
    )
    out = out.withColumn("score", F.greatest(F.lit(0.0), score))
    s = F.col("score")
    status = F.when(s >= 90, "EXCELLENT").when(s >= 75, "GOOD").when(s >= 60, "ACCEPTABLE").otherwise("POOR")
    return out.withColumn("status", status)


def target_readiness(df: DataFrame, targets: Sequence[str] = TARGETS, keys: Sequence[str] = KEYS) -> DataFrame:
    """100 less 10 for more than 5% z-outliers, less 15 for more than 10% zeros; ready from 70."""
    z = zscore_report(df, targets, keys=keys).select(*keys, "column", F.col("percent").alias("outlier_percent"))
    zeros = per_column(df, targets, {"zero_percent": lambda c: percent(count_if(c == 0), rows())}, keys)
    out = z.join(zeros, [*keys, "column"])
    score = (
        F.lit(100)
        - F.when(F.col("outlier_percent") > 5, 10).otherwise(0)
        - F.when(F.col("zero_percent") > 10, 15).otherwise(0)
    )
    return out.withColumn("readiness", score).withColumn("ready", F.col("readiness") >= 70)


WEATHER = ["temperature", "humidity", "wind_speed", "pressure"]


def outlier_context(df: DataFrame, target: str = "pm2_5", keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """Do readings above the upper fence come with weather that explains them?

    Three conditions: lower wind, humidity higher by five, temperature off by three.
    """
    by = list(keys)
    q = wide_quantiles(exact_quantiles(df, [target], [0.25, 0.75], keys), [0.25, 0.75], ["_q1", "_q3"], keys)
    joined = beside(df, q.drop("column"), keys, ["_q1", "_q3"])
    upper = F.col("_q3") + (F.col("_q3") - F.col("_q1")) * 1.5
    marked = joined.withColumn("_out", F.coalesce(F.col(target) > upper, F.lit(False)))
    rush = F.hour(time).between(7, 9) | F.hour(time).between(17, 19)
    counts = marked.groupBy(*by).agg(
        count_if(F.col("_out")).alias("outliers"),
        F.try_divide(count_if(F.col("_out") & rush).cast("double"), count_if(F.col("_out"))).alias("rush_share"),
    )
    means = contrast_means(marked, "_out", [c for c in WEATHER if c in df.columns], keys)
    d = lambda c: F.max(F.when(F.col("column") == c, F.col("difference")))
    wide = means.groupBy(*by).agg(
        d("wind_speed").alias("wind_difference"),
        d("humidity").alias("humidity_difference"),
        d("temperature").alias("temperature_difference"),
    )
    met = (
        F.when(F.col("wind_difference") < 0, 1).otherwise(0)
        + F.when(F.col("humidity_difference") > 5, 1).otherwise(0)
        + F.when(F.abs("temperature_difference") > 3, 1).otherwise(0)
    )
    out = counts.filter(F.col("outliers") > 0).join(wide, by).withColumn("legitimacy", met / F.lit(3.0))
    s = F.col("legitimacy")
    return out.withColumn(
        "assessment", F.when(s >= 0.7, "likely real").when(s >= 0.4, "mixed").otherwise("likely sensor errors")
    ).withColumn("rush_hour_linked", F.col("rush_share") > 0.3)


def alignment_report(
    df: DataFrame, features: Sequence[str], targets: Sequence[str] = TARGETS, flag: str = "is_train", keys: Sequence[str] = KEYS,
    limits: dict[str, float] | None = None,
) -> DataFrame:
    """Training and test part side by side: rows, targets per row, feature range, nulls, verdict.

    ``targets_suspicious``: the mean of a target lies beyond ``limits``, as that of one on another
    scale would.
    """
    limits = TARGET_MEAN_LIMITS if limits is None else limits
    nulls = lambda cols: F.sum(sum((F.col(c).isNull().cast("bigint") for c in cols), F.lit(0)))
    out = df.groupBy(*keys, flag).agg(
        rows().alias("rows"),
        *[F.count(t).alias(f"n_{t}") for t in targets],
        *[F.avg(t).alias(f"mean_{t}") for t in targets],
        F.min(F.least(*features)).alias("feature_min"),
        F.max(F.greatest(*features)).alias("feature_max"),
        nulls(features).alias("feature_nulls"),
    )
    aligned = F.col("feature_nulls") == 0
    for t in targets:
        aligned = aligned & (F.col(f"n_{t}") == F.col("rows"))
    odd = (F.col("feature_min") < -10) | (F.col("feature_max") > 10)
    far = F.lit(False)
    for t, limit in limits.items():
        if t in targets:
            far = far | F.coalesce(F.abs(F.col(f"mean_{t}")) > limit, F.lit(False))
    return out.withColumn("range_suspicious", odd).withColumn("targets_suspicious", far).withColumn("aligned", aligned)
