"""Lead-lag, autocorrelation and interaction analysis of regular series."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breezeframe.functions.features import predictability_label, tiered
from breezeframe.operators.aggregates import corr_pairs
from breezeframe.operators.layout import with_position
from breezeframe.operators.windows import shift
from breezeframe.schema import KEYS, REPORT_HORIZONS, SEQ, TARGETS, TIME

# the solver of ``pacf`` travels by value: workers need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lead_lag_corr(
    df: DataFrame,
    features: Sequence[str],
    targets: Sequence[str] = TARGETS,
    horizons: Sequence[int] = REPORT_HORIZONS,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Correlation of each feature now with each target ``h`` rows later: one shift, one aggregate."""
    cols = list(dict.fromkeys([*features, *targets]))
    slim = df.select(*dict.fromkeys([*keys, TIME, SEQ, *cols]))
    ahead = shift(slim, {f"_y_{t}__{h}": (t, -h) for t in targets for h in horizons}, keys)
    pairs = [(f, f"_y_{t}__{h}") for f in features for t in targets for h in horizons]
    long = corr_pairs(ahead, pairs, keys, ("x", "_y"))
    parts = F.split(F.substring("_y", 4, 10_000), "__")
    return long.select(
        *keys, "x", parts[0].alias("target"), parts[1].cast("int").alias("h"), "r", "n"
    )


def weather_lead_lag(df: DataFrame, weather, targets=TARGETS, leads=(0, 3, 6, 12, 24, 48, 72), min_n: int = 20, keys=KEYS):
    """Lead-lag pairs with more than ``min_n`` common rows and a defined correlation."""
    ll = lead_lag_corr(df, weather, targets, leads, keys)
    return ll.filter((F.col("n") > min_n) & F.col("r").isNotNull())


def persistence_corr(df: DataFrame, cols: Sequence[str] = TARGETS, horizons=REPORT_HORIZONS, keys=KEYS) -> DataFrame:
    """Correlation of each series with its own future."""
    slim = df.select(*keys, TIME, SEQ, *cols)
    ahead = shift(slim, {f"_y_{c}__{h}": (c, -h) for c in cols for h in horizons}, keys)
    long = corr_pairs(ahead, [(c, f"_y_{c}__{h}") for c in cols for h in horizons], keys, ("target", "_y"))
    h = F.element_at(F.split("_y", "__"), -1).cast("int")
    return long.select(*keys, "target", h.alias("h"), "r", "n")


def topk_by_abs(df: DataFrame, k: int, by: Sequence[str], name: str, r: str = "r") -> DataFrame:
    """The ``k`` largest absolute correlations of each group, ranked.

    Values equal to twelve digits tie; names break ties.
    """
    w = Window.partitionBy(*by).orderBy(F.round(F.abs(r), 12).desc(), name)
    return df.filter(F.col(r).isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def effectiveness(
    df: DataFrame,
    columns: Mapping[str, tuple[str, int]],
    horizons: Sequence[int] = (6, 12, 24, 48, 72),
    only_shorter: bool = False,
    min_n: int = 10,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """How well engineered columns predict their own target: ``{column: (target, hours)}``.

    ``only_shorter`` keeps lags shorter than the horizon. Pairs need more than ``min_n`` rows.
    """
    chosen = sorted({t for t, _ in columns.values()})
    ll = lead_lag_corr(df, list(columns), chosen, horizons, keys)
    keep = None
    for c, (t, hours) in columns.items():
        own = (F.col("x") == c) & (F.col("target") == t)
        if only_shorter:
            own = own & (F.col("h") > hours)
        keep = own if keep is None else keep | own
    return ll.filter(keep & (F.col("n") > min_n) & F.col("r").isNotNull())


def effectiveness_summary(effect: DataFrame, k: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Best column, mean absolute correlation of the best ``k``, and a quality label per horizon."""
    top = topk_by_abs(effect, k, [*keys, "target", "h"], "x")
    out = top.groupBy(*keys, "target", "h").agg(
        F.max(F.when(F.col("rank") == 1, F.col("x"))).alias("best"), F.avg(F.abs("r")).alias("avg_abs_r")
    )
    label = tiered(F.col("avg_abs_r"), [(0.6, "Excellent"), (0.4, "Good"), (0.2, "Moderate")], "Poor")
    return out.withColumn("quality", label)


def utility(effect: DataFrame, k: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of horizons in which a column is among the best ``k``, and its mean importance."""
    by = [*keys, "target"]
    top = topk_by_abs(effect, k, [*by, "h"], "x").groupBy(*by, "x").agg(F.count(F.lit(1)).alias("hits"))
    total = effect.groupBy(*by).agg(F.count_distinct("h").alias("horizons"))
    means = effect.groupBy(*by, "x").agg(F.avg(F.abs("r")).alias("importance"))
    return means.join(total, by).join(top, [*by, "x"], "left").select(
        *by, "x", (F.coalesce("hits", F.lit(0)) / F.col("horizons")).alias("utility"), "importance"
    )


def best_predictor(ll: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Strongest predictor, mean absolute correlation and reading per lead."""
    by = [*keys, "target", "h"]
    out = ll.filter(F.col("r").isNotNull()).groupBy(*by).agg(
        F.min_by("x", F.struct(-F.round(F.abs("r"), 12), "x")).alias("best"),
        F.max(F.abs("r")).alias("best_abs_r"),
        F.avg(F.abs("r")).alias("avg_abs_r"),
    )
    label = tiered(F.col("avg_abs_r"), [(0.3, "Strong"), (0.2, "Moderate"), (0.1, "Weak")], "Very limited")
    return out.withColumn("assessment", label)


DAYS = {"day1": (6, 12, 24), "day2": (36, 48), "day3": (72,)}


def day_means(per_lead: DataFrame, value: str = "avg_abs_r", keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean per forecast day; a lead that was not evaluated counts as 0."""

    def mean(hours):
        terms = [F.coalesce(F.max(F.when(F.col("h") == h, F.col(value))), F.lit(0.0)) for h in hours]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total / float(len(hours))

    return per_lead.groupBy(*keys, "target").agg(*[mean(hs).alias(d) for d, hs in DAYS.items()])


def feasibility(auto: DataFrame, lags: DataFrame, weather: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean strength per forecast day of three measured sources, with a reading per day.

    Each input is a ``(keys, target, day1, day2, day3)`` table, see ``day_means``.
    """
    by = [*keys, "target"]
    parts = [t.select(*by, *[F.col(d).alias(f"{d}_{i}") for d in DAYS]) for i, t in enumerate((auto, lags, weather))]
    joined = parts[0].join(parts[1], by).join(parts[2], by)
    scores = {f"{d}_score": (F.col(f"{d}_0") + F.col(f"{d}_1") + F.col(f"{d}_2")) / 3.0 for d in DAYS}
    steps = {
        "day1": ([(0.5, "Excellent"), (0.4, "Good"), (0.3, "Moderate")], "Challenging"),
        "day2": ([(0.4, "Good"), (0.3, "Moderate"), (0.2, "Challenging")], "Difficult"),
        "day3": ([(0.3, "Feasible"), (0.2, "Challenging"), (0.15, "Difficult")], "Very difficult"),
    }
    out = joined.select(*by, *[s.alias(n) for n, s in scores.items()])
    return out.withColumns({f"{d}_label": tiered(F.col(f"{d}_score"), *steps[d]) for d in DAYS})


# --- autocorrelation -----------------------------------------------------------------


def _lag_products(df: DataFrame, col: str, max_lag: int, keys: Sequence[str]) -> DataFrame:
    """Per key: n, sums of centred products at lags 0..max_lag as an array ``c``."""
    known = df.select(*keys, TIME, SEQ, col).filter(F.col(col).isNotNull())
    mean = known.groupBy(*keys).agg(F.avg(col).alias("_mu"))
    centred = known.join(mean, list(keys)).withColumn("_x", F.col(col) - F.col("_mu"))
    ahead = shift(centred.select(*keys, TIME, SEQ, "_x"), {f"_x{k}": ("_x", -k) for k in range(1, max_lag + 1)}, keys)
    sums = [F.sum(F.col("_x") * F.col("_x"))] + [
        F.coalesce(F.sum(F.col("_x") * F.col(f"_x{k}")), F.lit(0.0)) for k in range(1, max_lag + 1)
    ]
    return ahead.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("c"))


def acf(df: DataFrame, col: str, max_lag: int = 72, keys: Sequence[str] = KEYS) -> DataFrame:
    """Autocorrelation at lags 0..min(max_lag, n-1): global mean, biased denominator."""
    sums = _lag_products(df, col, max_lag, keys)
    long = sums.select(*keys, "n", "c", F.posexplode("c").alias("lag", "_s"))
    r = F.try_divide(F.col("_s"), F.element_at("c", 1))
    return long.filter(F.col("lag") < F.col("n")).select(
        *keys, "lag", r.alias("r"), "n", predictability_label(r).alias("label")
    )


def ljung_box(df: DataFrame, col: str, lags: int = 24, keys: Sequence[str] = KEYS) -> DataFrame:
    """Q statistic and p-value for 1..``lags`` lags."""
    a = acf(df, col, lags, keys).filter(F.col("lag") > 0)
    n = F.col("n")
    term = F.col("r") * F.col("r") / (n - F.col("lag"))
    running = Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    q = n * (n + 2) * F.sum(term).over(running)
    out = a.select(*keys, "lag", q.alias("q"))
    return out.withColumn("p_value", chi2_tail(F.col("q"), F.col("lag"))).withColumn(
        "significant", F.col("p_value") < 0.05
    )


def ljung_box_verdict(table: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """How many of the tested lags are significant, per key."""
    return table.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lags"), F.count(F.when(F.col("significant"), 1)).alias("significant_lags")
    )


def chi2_tail(q: Column, dof: Column) -> Column:
    """P(chi-square with ``dof`` degrees > q), by the finite series for whole degrees."""
    half = q / 2.0
    even = F.pmod(dof, F.lit(2)) == 0

    def series(first: Column, start: float, count: Column) -> Column:
        # first * (1 + half/(start) + half^2/(start(start+1)) + ...), ``count`` terms
        state = F.struct(first.alias("t"), F.lit(0.0).alias("s"))
        steps = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(
            steps, state,
            lambda a, i: F.struct((a["t"] * half / (i + F.lit(start))).alias("t"), (a["s"] + a["t"]).alias("s")),
            lambda a: a["s"],
        )

    by_even = series(F.exp(-half), 0.0, F.floor(dof / 2).cast("int"))
    root = F.sqrt(half)
    lead = F.exp(-half) * root * 2.0 / F.sqrt(F.pi())
    by_odd = erfc(root) + series(lead, 0.5, F.floor((dof - 1) / 2).cast("int"))
    return F.when(q <= 0, F.lit(1.0)).when(even, by_even).otherwise(by_odd)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0: power series below 2.5, continued fraction above."""
    small_terms, depth = 60, 60
    x2 = x * x
    state = F.struct(x.alias("t"), x.alias("s"))
    small = F.aggregate(
        F.sequence(F.lit(1), F.lit(small_terms)), state,
        lambda a, i: F.struct(
            (a["t"] * x2 * 2.0 / (i * 2.0 + 1.0)).alias("t"),
            (a["s"] + a["t"] * x2 * 2.0 / (i * 2.0 + 1.0)).alias("s"),
        ),
        lambda a: F.lit(1.0) - a["s"] * F.exp(-x2) * 2.0 / F.sqrt(F.pi()),
    )
    fraction = F.aggregate(
        F.sequence(F.lit(depth), F.lit(1)), x.cast("double"), lambda a, k: x + (k / 2.0) / a
    )
    large = F.exp(-x2) / (fraction * F.sqrt(F.pi()))
    return F.when(x < 2.5, small).otherwise(large)


def pacf(df: DataFrame, col: str, max_lag: int = 40, keys: Sequence[str] = KEYS) -> DataFrame:
    """Partial autocorrelation by least squares with intercept, lags 0..min(max_lag, n // 4).

    The fit of lag k uses every row that has k predecessors. Every sum of products such a fit
    needs is a sum over one lag, less a few products at either end of the series. So Spark adds up
    ``max_lag + 1`` lag products and keeps the first and last ``max_lag`` values; what reaches
    Python per key is that one row.
    """
    known = df.select(*keys, TIME, SEQ, col).filter(F.col(col).isNotNull())
    mean = known.groupBy(*keys).agg(F.avg(col).alias("_mu"))
    x0 = known.join(mean, list(keys)).withColumn("_x0", F.col(col) - F.col("_mu"))
    placed = with_position(x0, keys, "_pos", total="_all").select(*keys, TIME, SEQ, "_x0", "_pos", "_all")
    lagged = shift(placed, {f"_x{k}": ("_x0", k) for k in range(1, max_lag + 1)}, keys, pos="_pos")

    def end(inside) -> Column:
        # at most max_lag values
        kept = F.collect_list(F.when(inside, F.struct("_pos", "_x0")))
        return F.transform(F.sort_array(kept), lambda e: e["_x0"])

    sums = lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_x0").alias("total"),
        F.array(*[F.coalesce(F.sum(F.col("_x0") * F.col(f"_x{k}")), F.lit(0.0)) for k in range(max_lag + 1)]).alias("products"),
        end(F.col("_pos") <= max_lag).alias("head"), end(F.col("_pos") > F.col("_all") - max_lag).alias("tail"),
    )

    @F.pandas_udf("array<double>")
    def solve(n: pd.Series, total: pd.Series, products: pd.Series, head: pd.Series, tail: pd.Series) -> pd.Series:
        return pd.Series([_partials(*row, max_lag) for row in zip(n, total, products, head, tail)])

    partials = F.posexplode(solve("n", "total", "products", "head", "tail")).alias("lag", "r")
    solved = sums.select(*keys, F.col("n").alias("_n"), partials)
    return solved.filter(F.col("lag") <= F.floor(F.col("_n") / 4)).drop("_n")


def _gram(n, total, products, head, tail, m) -> np.ndarray:
    """Sums of products of x[t-i] and x[t-j] over the rows t that have ``m`` predecessors, and in
    the last row and column the plain sums."""
    g = np.zeros((m + 2, m + 2))
    if n <= m:
        return g
    head, tail = np.asarray(head, float), np.asarray(tail, float)
    for i in range(m + 1):
        for j in range(i, m + 1):
            d = j - i
            first = head[d : m - i] @ head[: m - i - d] if m - i > d else 0.0
            last = tail[m - i :] @ tail[m - i - d : m - d] if i else 0.0
            g[i, j] = g[j, i] = products[d] - first - last
        g[i, -1] = g[-1, i] = total - head[: m - i].sum() - tail[m - i :].sum()
    g[-1, -1] = n - m
    return g


def _partials(n, total, products, head, tail, max_lag) -> list[float]:
    """Last coefficient of each regression on k = 1..max_lag lags, from sums of products."""
    g = _gram(n, total, products, head, tail, max_lag)
    out = [1.0]
    for k in range(1, max_lag + 1):
        use = [*range(k + 1), max_lag + 1]
        block = g[np.ix_(use, use)].copy()
        for t in range(k, len(head)):
            row = np.append(head[t - k : t + 1][::-1], 1.0)
            block += np.outer(row, row)
        coef = np.linalg.lstsq(block[1:, 1:], block[1:, 0], rcond=None)[0]
        out.append(float(coef[k - 1]))
    return out


# --- interactions --------------------------------------------------------------------


def interaction_gain(
    df: DataFrame, pairs: Mapping[str, tuple[str, str]], targets: Sequence[str] = TARGETS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Correlation of each product with each target against that of its parts."""
    products = df.withColumns({n: F.col(a) * F.col(b) for n, (a, b) in pairs.items() if n not in df.columns})
    parts = sorted({p for ab in pairs.values() for p in ab})
    corr = corr_pairs(products, [(x, t) for x in [*pairs, *parts] for t in targets], keys, ("x", "target")).drop("n")
    of = F.explode(F.array(*[
        F.struct(F.lit(n).alias("interaction"), F.lit(x).alias("x"), F.lit(x == n).alias("own"))
        for n, ab in pairs.items() for x in (n, *ab)
    ]))
    spread = corr.groupBy(*keys, "target").agg(F.map_from_entries(F.collect_list(F.struct("x", "r"))).alias("_r"))
    long = spread.withColumn("_i", of).select(
        *keys, "target", "_i.interaction", "_i.own", F.try_element_at("_r", F.col("_i.x")).alias("r")
    )
    out = long.groupBy(*keys, "target", "interaction").agg(
        F.max(F.when(F.col("own"), F.col("r"))).alias("r"),
        F.max(F.when(~F.col("own"), F.abs("r"))).alias("best_part"),
    )
    gain = F.abs("r") - F.col("best_part")
    return out.withColumns({"gain": gain, "improves": gain > 0, "useful": (F.abs("r") > 0.1) & (gain > 0.01)})


def improvement_rate(gains: DataFrame, flag: str = "improves", keys: Sequence[str] = KEYS) -> DataFrame:
    """Percent of the defined comparisons that gain."""
    known = gains.filter(F.col("r").isNotNull())
    return known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), (F.avg(F.col(flag).cast("double")) * 100.0).alias("percent")
    )


def past_pm_weather(
    df: DataFrame, weather: Sequence[str], hours: Sequence[int], targets: Sequence[str] = TARGETS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Gain of past-PM times present-weather products over their parts."""
    slim = df.select(*dict.fromkeys([*keys, TIME, SEQ, *targets, *weather]))
    past = shift(slim, {f"{t}_past_{h}h": (t, h) for t in targets for h in hours}, keys)
    gains = None
    for t in targets:
        pairs = {f"{t}_past_{h}h_{w}_interaction": (f"{t}_past_{h}h", w) for h in hours for w in weather}
        one = interaction_gain(past, pairs, [t], keys)
        gains = one if gains is None else gains.unionByName(one)
    return gains


def top_features(corr: DataFrame, k: int, categories: Mapping[str, Sequence[str]], keys: Sequence[str] = KEYS) -> DataFrame:
    """The ``k`` strongest features of each key and target, marking the best of each category."""
    cat = F.coalesce(*[F.when(F.col("x").isin(*cols), F.lit(n)) for n, cols in categories.items()], F.lit("other"))
    named = corr.filter(F.col("r").isNotNull()).withColumn("category", cat)
    by = [*keys, "target"]
    best = named.groupBy(*by, "category").agg(F.min_by("x", F.struct(-F.round(F.abs("r"), 12), "x")).alias("_best"))
    marked = named.join(best, [*by, "category"]).withColumn("best_of_category", F.col("x") == F.col("_best")).drop("_best")
    return topk_by_abs(marked, k, by, "x")
