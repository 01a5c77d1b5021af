"""Descriptive statistics. Every report is one aggregate pass, reshaped afterwards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeframe.functions.features import tiered
from breezeframe.operators.layout import US_PER_HOUR, carried
from breezeframe.operators.quantiles import exact_quantiles, wide_quantiles
from breezeframe.schema import CONTRAST_LABELS, KEYS, TIME


def per_column(
    df: DataFrame,
    cols: Sequence[str],
    measures: Mapping[str, object],
    keys: Sequence[str] = KEYS,
    name: str = "column",
) -> DataFrame:
    """``measures`` (name -> function of a column giving an aggregate) for all columns in one
    pass, as a long table with one row per key and column."""
    one = df.groupBy(*keys).agg(*[m(F.col(c)).alias(f"{k}__{c}") for c in cols for k, m in measures.items()])
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), *[F.col(f"{k}__{c}").alias(k) for k in measures]) for c in cols
    ]))
    return one.select(*keys, cells.alias("_c")).select(*keys, "_c.*")




def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def rows() -> Column:
    return F.count(F.lit(1))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def describe(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    stats = per_column(
        df, cols,
        {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max},
        keys,
    )
    probs, names = [0.25, 0.5, 0.75], ["q25", "q50", "q75"]
    q = wide_quantiles(exact_quantiles(df, cols, probs, keys), probs, names, keys)
    return stats.join(q, [*keys, "column"], "left")


def group_stats(
    df: DataFrame, by: str, target: str, keys: Sequence[str] = KEYS, digits: int | None = 2
) -> DataFrame:
    """Mean, deviation and count per category, best and worst category of the key."""

    def shown(c: Column) -> Column:
        return c if digits is None else F.rint(c * 10.0**digits) / 10.0**digits

    g = df.groupBy(*keys, by).agg(
        shown(F.avg(target)).alias("mean"),
        shown(F.stddev_samp(target)).alias("std"),
        F.count(target).alias("count"),
    )
    known = g.filter(F.col("mean").isNotNull())
    best = known.groupBy(*keys).agg(
        F.min_by(by, F.struct(-F.col("mean"), by)).alias("highest"),
        F.min_by(by, F.struct("mean", by)).alias("lowest"),
    )
    return g.join(best, list(keys), "left")


def value_counts(df: DataFrame, col: str, keys: Sequence[str] = KEYS) -> DataFrame:
    counts = df.groupBy(*keys, col).agg(rows().alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return counts.join(total, list(keys)).withColumn("percent", percent(F.col("n"), F.col("_t"))).drop("_t")


def flag_rates(df: DataFrame, flags: Sequence[str] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows per set flag and their share."""
    flags = [c for c in df.columns if c.startswith("is_")] if flags is None else flags
    return per_column(
        df, flags,
        {"n": F.sum, "percent": lambda c: percent(F.sum(c), F.count(F.lit(1)))},
        keys, "flag",
    )


def missing_report(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    return per_column(
        df, cols,
        {"missing": lambda c: count_if(c.isNull()), "percent": lambda c: percent(count_if(c.isNull()), rows())},
        keys,
    )


def zero_report(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    return per_column(
        df, cols,
        {"zeros": lambda c: count_if(c == 0), "percent": lambda c: percent(count_if(c == 0), rows())},
        keys,
    )


def uniqueness_report(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS, approximate: bool = False
) -> DataFrame:
    """Distinct values per column, their share of the rows, and a label below 1% and above 95%.

    Distinct values are found by grouping on (key, column, value), which spreads over the
    cluster; nothing is collected per key.
    """
    if approximate:
        base = per_column(df, cols, {"n_unique": F.approx_count_distinct, "_rows": lambda c: rows()}, keys)
    else:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])
        cells = df.select(*keys, F.explode(pairs).alias("_x")).groupBy(*keys, "_x.column", "_x.v").agg(rows().alias("c"))
        base = cells.groupBy(*keys, "column").agg(F.count("v").alias("n_unique"), F.sum("c").alias("_rows"))
    ratio = F.col("n_unique") / F.col("_rows")
    label = F.when(ratio < 0.01, "low").when(ratio > 0.95, "high").otherwise("normal")
    return base.select(*keys, "column", "n_unique", ratio.alias("ratio"), label.alias("label"))


def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Later copies of full rows, per key."""
    cols = list(cols or df.columns)
    groups = df.groupBy(*dict.fromkeys([*keys, *cols])).agg(rows().alias("c"))
    return groups.groupBy(*keys).agg(F.sum("c").alias("rows"), F.sum(F.col("c") - 1).alias("duplicates"))


def mode_of(df: DataFrame, col: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """All most frequent non-null values of each key, with the smallest marked."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(rows().alias("n"))
    top = counts.groupBy(*keys).agg(F.max("n").alias("n"))
    modes = counts.join(top, [*keys, "n"])
    first = modes.groupBy(*keys).agg(F.min(col).alias("_first"))
    return modes.join(first, list(keys)).withColumn("is_smallest", F.col(col) == F.col("_first")).drop("_first")


def median(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    return exact_quantiles(df, cols, [0.5], keys).select(*keys, "column", F.col("value").alias("median"))


# --- shape ---------------------------------------------------------------------------


def _skew_label(s: Column) -> Column:
    side = F.when(s > 0, " Right").otherwise(" Left")
    return (
        F.when(F.abs(s) < 0.5, F.lit("Normal"))
        .when(F.abs(s) < 1.0, F.concat(F.lit("Moderate"), side))
        .otherwise(F.concat(F.lit("High"), side))
    )


def _kurtosis_label(k: Column) -> Column:
    return F.when(F.abs(k) < 1.0, "Normal").when(k > 1.0, "Heavy-tailed").otherwise("Light-tailed")


def shape_stats(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Population skewness and excess kurtosis with their reading."""
    s = per_column(df, cols, {"skewness": F.skewness, "kurtosis": F.kurtosis}, keys)
    text = F.concat_ws(", ", _skew_label(F.col("skewness")), _kurtosis_label(F.col("kurtosis")))
    return s.withColumn("interpretation", text)


def _log_positive(c: Column) -> Column:
    return F.when(c > 0, F.log1p(c))


def jarque_bera(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Normality test on values and on log1p of the positive ones, with a transform advice."""
    s = per_column(
        df, cols,
        {
            "n": F.count, "s": F.skewness, "k": F.kurtosis,
            "log_n": lambda c: F.count(_log_positive(c)),
            "log_s": lambda c: F.skewness(_log_positive(c)),
            "log_k": lambda c: F.kurtosis(_log_positive(c)),
        },
        keys,
    )

    def stat(p: str) -> Column:
        s_, k_ = F.col(f"{p}s"), F.col(f"{p}k")
        return F.col(f"{p}n") / 6.0 * (s_ * s_ + k_ * k_ / 4.0)

    s = s.withColumns({"jb": stat(""), "log_jb": stat("log_")})
    # chi-square tail with two degrees of freedom
    s = s.withColumns({"p_value": F.exp(F.col("jb") * -0.5), "log_p_value": F.exp(F.col("log_jb") * -0.5)})
    advice = (
        F.when(F.col("p_value") > 0.05, "No")
        .when(F.col("log_p_value") > 0.05, "Yes - Better")
        .when(F.col("log_p_value") > F.col("p_value"), "Yes - Improved")
        .otherwise("Maybe")
    )
    return s.withColumn("recommendation", advice).drop("s", "k", "log_s", "log_k")


def log_skew_gain(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    s = per_column(
        df, cols,
        {"skew": F.skewness, "log_skew": lambda c: F.skewness(_log_positive(c))},
        keys,
    )
    gain = F.abs("skew") - F.abs("log_skew")
    label = F.when(gain > 0.1, "Better").when(gain > 0, "Slight").otherwise("Worse")
    return s.withColumns({"gain": gain, "improvement": label})


# --- correlation ---------------------------------------------------------------------


def corr_pairs(
    df: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = KEYS, names=("x", "y")
) -> DataFrame:
    """Pearson correlation and pair count of many column pairs in one pass, long form.

    A pair uses the rows on which both are known. Zero variance gives null.
    """
    one = df.groupBy(*keys).agg(*[
        e
        for i, (x, y) in enumerate(pairs)
        for e in (
            F.corr(x, y).alias(f"r{i}"),
            count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias(f"n{i}"),
        )
    ])
    cells = F.explode(F.array(*[
        F.struct(
            F.lit(x).alias(names[0]), F.lit(y).alias(names[1]),
            F.nanvl(F.col(f"r{i}"), F.lit(None).cast("double")).alias("r"), F.col(f"n{i}").alias("n"),
        )
        for i, (x, y) in enumerate(pairs)
    ]))
    return one.select(*keys, cells.alias("_c")).select(*keys, "_c.*")


def corr_matrix(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Full matrix in long form; each unordered pair is computed once."""
    half = corr_pairs(df, [(a, b) for i, a in enumerate(cols) for b in cols[i:]], keys)
    both = F.when(
        F.col("x") == F.col("y"), F.array(F.struct("x", "y"))
    ).otherwise(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    return half.withColumn("_b", F.explode(both)).select(*keys, "_b.x", "_b.y", "r", "n")


# --- series profiles -----------------------------------------------------------------


def time_profile(df: DataFrame, keys: Sequence[str] = KEYS, time: str = TIME, **kw) -> DataFrame:
    """First and last time, whole days between, records per day, most common interval."""
    span = df.groupBy(*keys).agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"), rows().alias("records"))
    days = F.floor((F.unix_micros("last_time") - F.unix_micros("first_time")) / (24.0 * US_PER_HOUR))
    step = F.unix_micros(time) - F.unix_micros(F.col(f"_prev_{time}"))
    gaps = carried(df, [time], keys, time=time, **kw).withColumn("step_us", step)
    common = mode_of(gaps, "step_us", keys).filter("is_smallest").select(*keys, F.col("step_us").alias("common_step_us"))
    return (
        span.withColumn("days", days)
        .withColumn("records_per_day", F.try_divide(F.col("records"), F.col("days")))
        .join(common, list(keys), "left")
    )


def histogram(df: DataFrame, col: str, bins: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Equal-width bins over each key's own range; the maximum falls into the last bin."""
    known = df.filter(F.col(col).isNotNull())
    span = known.groupBy(*keys).agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    place = F.least(
        F.coalesce(
            F.floor(F.try_divide(F.col(col) - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(0)
        ),
        F.lit(bins - 1),
    ).cast("int")
    counts = known.join(span, list(keys)).groupBy(*keys, place.alias("bin"), "lo", "hi").agg(rows().alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    return counts.select(
        *keys, "bin", (F.col("lo") + width * F.col("bin")).alias("bin_lo"),
        (F.col("lo") + width * (F.col("bin") + 1)).alias("bin_hi"), "n",
    )


def next24_stats(df: DataFrame, value: str = "aqi", h: str = "h", keys: Sequence[str] = KEYS) -> DataFrame:
    return df.filter(F.col(h) <= 24).groupBy(*keys).agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean")
    )


def near_max_share(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS, share: float = 0.9) -> DataFrame:
    """How often each column reaches ``share`` of the largest one in its row."""
    top = F.greatest(*cols)
    close = {c: F.when((top > 0) & (F.col(c) >= top * share), 1) for c in cols}
    marked = df.select(*keys, *[v.alias(c) for c, v in close.items()])
    return per_column(
        marked, cols, {"n": F.count, "percent": lambda c: percent(F.count(c), rows())}, keys
    )


def aqi_gap_stats(df: DataFrame, full: str, stored: str, keys: Sequence[str] = KEYS, limit: float = 10) -> DataFrame:
    """Where the stored index understates the full one."""
    gap = F.col(full) - F.col(stored)
    return df.groupBy(*keys).agg(
        count_if(gap > limit).alias("underestimated"),
        F.max(gap).alias("max_gap"),
        F.avg(gap).alias("mean_gap"),
        F.stddev_samp(gap).alias("std_gap"),
        F.count(gap).alias("n"),
    )


def contrast_means(df: DataFrame, marked: str, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Means inside and outside a marked set, their difference and its reading."""
    flag = F.coalesce(F.col(marked), F.lit(False))
    t = per_column(
        df, cols,
        {"inside": lambda c: F.avg(F.when(flag, c)), "outside": lambda c: F.avg(F.when(~flag, c))},
        keys,
    )
    d = F.col("inside") - F.col("outside")
    label = F.when(F.abs(d) > F.abs(F.col("outside")) * 0.1, "Different").otherwise("Similar")
    for c, (limit, low, high) in CONTRAST_LABELS.items():
        text = F.when(d < -limit, low).when(F.abs(d) < limit, "Normal").otherwise(high)
        label = F.when(F.col("column") == c, text).otherwise(label)
    return t.withColumn("difference", d).withColumn("label", F.when(d.isNotNull(), label))


def predictor_tier(r: Column) -> Column:
    return tiered(r, [(0.3, "TIER 1"), (0.2, "TIER 2"), (0.1, "TIER 3")], "TIER 4")


def rank_predictors(
    corr: DataFrame, predictor: str = "x", target: str | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Average and largest absolute correlation per predictor (zeros and nulls left out) and its tier."""
    by = [*keys, predictor, *([target] if target else [])]
    known = corr.filter(F.col("r").isNotNull() & (F.col("r") != 0))
    ranked = known.groupBy(*by).agg(F.avg(F.abs("r")).alias("avg_abs_r"), F.max(F.abs("r")).alias("max_abs_r"))
    return ranked.withColumn("tier", predictor_tier(F.col("avg_abs_r")))


def group_verdict(
    ranked: DataFrame, groups: Mapping[str, Sequence[str]], predictor: str = "x", keys: Sequence[str] = KEYS, limit: float = 0.2
) -> DataFrame:
    """How many predictors of each of two groups are strong for some target, and which group leads."""
    (a, a_cols), (b, b_cols) = groups.items()
    strong = ranked.groupBy(*keys, predictor).agg(F.max("avg_abs_r").alias("_m"))
    hit = F.col("_m") > limit
    out = strong.groupBy(*keys).agg(
        count_if(hit & F.col(predictor).isin(*a_cols)).alias(f"strong_{a}"),
        count_if(hit & F.col(predictor).isin(*b_cols)).alias(f"strong_{b}"),
    )
    x, y = F.col(f"strong_{a}"), F.col(f"strong_{b}")
    return out.withColumn("verdict", F.when(x > y, a).when(y > x, b).otherwise("both"))


