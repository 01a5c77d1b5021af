"""Descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeframe import fixtures as X
from breezeframe.catalog.registry import query
from breezeframe.catalog.scalars import (
    ANALYSIS,
    AQI_SQL,
    BP,
    BPM,
    CARDINAL_SQL,
    INDIVIDUAL_SQL,
    THRESHOLD_SQL,
    analysis_sql,
    clamped_sql,
    flags_sql,
    individual,
)
from breezeframe.fixtures import LAST_HOURS, PANEL, READINGS, panel_hourly, readings
from breezeframe.functions import features as G
from breezeframe.functions.aqi import aqi_clamped, with_aqi
from breezeframe.operators import aggregates as A
from breezeframe.operators.analytics import lead_lag_corr
from breezeframe.schema import MEASURES, THRESHOLDS

COLS = ["pm2_5", "pm10", "temperature", "sulphur_dioxide"]


def stack(cols, body: str, src: str = "readings", tail: str = "GROUP BY station", name: str = '"column"') -> str:
    """One SELECT per column, glued together; {c} stands for the column."""
    return " UNION ALL ".join(
        f"SELECT station, '{c}' AS {name}, {body.replace('{c}', c)} FROM {src} {tail}" for c in cols
    )


@query(
    "a1_describe",
    f"WITH {READINGS} "
    + stack(COLS, """count({c}) AS "count", avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS "min", max({c}) AS "max",
quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75"""),
    dbl="mean std q25 q50 q75",
)
def a1(spark, sf):
    return A.describe(readings(spark, sf), COLS)


@query(
    "a2_group_stats",
    f"""WITH {READINGS}, g AS (SELECT station, wind_cardinal, round_even(avg(pm2_5), 2) AS mean, round_even(stddev_samp(pm2_5), 2) AS std,
count(pm2_5) AS "count" FROM (SELECT *, {CARDINAL_SQL} AS wind_cardinal FROM readings) GROUP BY ALL)
SELECT *, first(wind_cardinal) OVER (PARTITION BY station ORDER BY mean DESC NULLS LAST, wind_cardinal) AS highest,
first(wind_cardinal) OVER (PARTITION BY station ORDER BY mean NULLS LAST, wind_cardinal) AS lowest FROM g""",
    dbl="mean std",
)
def a2(spark, sf):
    r = readings(spark, sf).withColumn("wind_cardinal", G.cardinal(F.col("wind_direction")))
    return A.group_stats(r, "wind_cardinal", "pm2_5")


@query(
    "a3_value_counts",
    f"""WITH {READINGS} SELECT station, wind_cardinal, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY station) AS percent
FROM (SELECT *, {CARDINAL_SQL} AS wind_cardinal FROM readings) GROUP BY station, wind_cardinal""",
    dbl="percent",
)
def a3(spark, sf):
    r = readings(spark, sf).select("station", G.cardinal(F.col("wind_direction")).alias("wind_cardinal"))
    return A.value_counts(r, "wind_cardinal")


@query(
    "a4_flag_rates",
    f"WITH {READINGS}, f AS (SELECT station, {flags_sql(THRESHOLD_SQL)} FROM readings) "
    + stack(THRESHOLDS, "CAST(sum({c}) AS BIGINT) AS n, sum({c}) * 100.0::DOUBLE / count(*) AS percent", "f", name="flag"),
    dbl="percent",
)
def a4(spark, sf):
    return A.flag_rates(G.threshold_flags(readings(spark, sf)))


@query(
    "a5_missing_report",
    f"WITH {READINGS} " + stack(MEASURES, "count(*) - count({c}) AS missing, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS percent"),
    dbl="percent",
)
def a5(spark, sf):
    return A.missing_report(readings(spark, sf), MEASURES)


@query(
    "a6_zero_report",
    f"WITH {READINGS} "
    + stack(MEASURES, "count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} = 0) * 100.0::DOUBLE / count(*) AS percent"),
    dbl="percent",
)
def a6(spark, sf):
    return A.zero_report(readings(spark, sf), MEASURES)


@query(
    "a7_uniqueness_report",
    f"WITH {READINGS} "
    + stack([*MEASURES, "seq"], """count(DISTINCT {c}) AS n_unique, count(DISTINCT {c}) / count(*)::DOUBLE AS ratio,
CASE WHEN count(DISTINCT {c}) / count(*)::DOUBLE < 0.01 THEN 'low' WHEN count(DISTINCT {c}) / count(*)::DOUBLE > 0.95 THEN 'high' ELSE 'normal' END AS label"""),
    dbl="ratio",
)
def a7(spark, sf):
    return A.uniqueness_report(readings(spark, sf), [*MEASURES, "seq"])


@query(
    "a8_duplicate_count",
    f"""WITH {READINGS} SELECT station, CAST(sum(c) AS BIGINT) AS rows, CAST(sum(c - 1) AS BIGINT) AS duplicates
FROM (SELECT station, temperature, wind_speed, count(*) AS c FROM readings GROUP BY ALL) GROUP BY station""",
)
def a8(spark, sf):
    return A.duplicate_count(readings(spark, sf).select("station", "temperature", "wind_speed"))


@query(
    "a9_mode_of",
    f"""WITH {READINGS}, c AS (SELECT station, hour(time) AS hour, count(*) AS n FROM readings GROUP BY ALL)
SELECT station, CAST(hour AS INTEGER) AS hour, n, hour = min(hour) OVER (PARTITION BY station) AS is_smallest
FROM (SELECT *, max(n) OVER (PARTITION BY station) AS m FROM c) WHERE n = m""",
)
def a9(spark, sf):
    return A.mode_of(readings(spark, sf).select("station", F.hour("time").alias("hour")), "hour")


@query("a10_median", f"WITH {READINGS} " + stack(MEASURES, "quantile_cont({c}, 0.5) AS median"), dbl="median")
def a10(spark, sf):
    return A.median(readings(spark, sf), MEASURES)


def moments(c: str) -> tuple[str, str]:
    """Population skewness and excess kurtosis by central sums over a windowed mean ``m``."""
    m2, m3, m4 = (f"avg(pow({c} - m, {i}))" for i in (2, 3, 4))
    return f"{m3} / pow({m2}, 1.5)", f"{m4} / pow({m2}, 2) - 3"


def centred(expr: str) -> str:
    return f"(SELECT station, x, avg(x) OVER (PARTITION BY station) AS m FROM (SELECT station, {expr} AS x FROM readings))"


SKEW, KURT = moments("x")
SHAPE = ["pm2_5", "pm10", "temperature", "humidity"]


def shape_sql(c: str, log: bool = False) -> str:
    expr = f"CASE WHEN {c} > 0 THEN ln(1 + {c}) END" if log else c
    return f"(SELECT station, count(x) AS n, {SKEW} AS s, {KURT} AS k FROM {centred(expr)} GROUP BY station)"


@query(
    "a11_shape_stats",
    f"WITH {READINGS} SELECT station, \"column\", s AS skewness, k AS kurtosis, concat("
    "CASE WHEN abs(s) < 0.5 THEN 'Normal' WHEN abs(s) < 1 THEN 'Moderate' ELSE 'High' END, "
    "CASE WHEN abs(s) < 0.5 THEN '' WHEN s > 0 THEN ' Right' ELSE ' Left' END, ', ', "
    "CASE WHEN abs(k) < 1 THEN 'Normal' WHEN k > 1 THEN 'Heavy-tailed' ELSE 'Light-tailed' END) AS interpretation FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", * FROM {shape_sql(c)}" for c in SHAPE) + ")",
    dbl="skewness kurtosis",
)
def a11(spark, sf):
    return A.shape_stats(readings(spark, sf), SHAPE)


JB = "{a}.n / 6.0 * (pow({a}.s, 2) + pow({a}.k, 2) / 4)"


@query(
    "a12_jarque_bera",
    f"WITH {READINGS} SELECT *, CASE WHEN p_value > 0.05 THEN 'No' WHEN log_p_value > 0.05 THEN 'Yes - Better' "
    "WHEN log_p_value > p_value THEN 'Yes - Improved' ELSE 'Maybe' END AS recommendation FROM (SELECT *, exp(-jb / 2) AS p_value, "
    "exp(-log_jb / 2) AS log_p_value FROM ("
    + " UNION ALL ".join(
        f"SELECT a.station, '{c}' AS \"column\", a.n, b.n AS log_n, {JB.format(a='a')} AS jb, {JB.format(a='b')} AS log_jb "
        f"FROM {shape_sql(c)} a JOIN {shape_sql(c, True)} b USING (station)"
        for c in ("pm2_5", "pm10")
    )
    + "))",
    dbl="jb log_jb p_value log_p_value",
)
def a12(spark, sf):
    return A.jarque_bera(readings(spark, sf), ["pm2_5", "pm10"])


@query(
    "a13_log_skew_gain",
    f"WITH {READINGS} SELECT *, abs(skew) - abs(log_skew) AS gain, CASE WHEN abs(skew) - abs(log_skew) > 0.1 THEN 'Better' "
    "WHEN abs(skew) - abs(log_skew) > 0 THEN 'Slight' ELSE 'Worse' END AS improvement FROM ("
    + " UNION ALL ".join(
        f"SELECT a.station, '{c}' AS \"column\", a.s AS skew, b.s AS log_skew FROM {shape_sql(c)} a JOIN {shape_sql(c, True)} b USING (station)"
        for c in SHAPE
    )
    + ")",
    dbl="skew log_skew gain",
)
def a13(spark, sf):
    return A.log_skew_gain(readings(spark, sf), SHAPE)


CORR = ["pm2_5", "pm10", "temperature", "humidity", "pressure", "wind_speed", "ozone", "nh3"]


@query(
    "a14_corr_matrix",
    f"WITH {READINGS} "
    + " UNION ALL ".join(
        f"SELECT station, '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM readings GROUP BY station"
        for a in CORR for b in CORR
    ),
    dbl="r",
)
def a14(spark, sf):
    return A.corr_matrix(readings(spark, sf), CORR)


@query(
    "a15_time_profile",
    f"""WITH {READINGS}, d AS (SELECT station, time, epoch_us(time) - epoch_us(lag(time) OVER (PARTITION BY station ORDER BY time, seq)) AS step FROM readings),
c AS (SELECT station, step, count(*) AS n FROM d WHERE step IS NOT NULL GROUP BY ALL),
m AS (SELECT station, first(step ORDER BY n DESC, step) AS common_step_us FROM c GROUP BY station)
SELECT station, first_time, last_time, records, days, records / days::DOUBLE AS records_per_day, common_step_us
FROM (SELECT station, min(time) AS first_time, max(time) AS last_time, count(*) AS records,
 CAST(floor((epoch_us(max(time)) - epoch_us(min(time))) / 86400000000.0) AS BIGINT) AS days FROM readings GROUP BY station) JOIN m USING (station)""",
    dbl="records_per_day",
)
def a15(spark, sf):
    return A.time_profile(readings(spark, sf).select("station", "seq", "time"))


@query(
    "a16_histogram",
    f"""WITH {READINGS}, s AS (SELECT station, min(pm2_5) AS lo, max(pm2_5) AS hi FROM readings GROUP BY station)
SELECT station, bin, lo + (hi - lo) / 20 * bin AS bin_lo, lo + (hi - lo) / 20 * (bin + 1) AS bin_hi, n FROM
(SELECT station, lo, hi, CAST(least(floor((pm2_5 - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, count(*) AS n
 FROM readings JOIN s USING (station) WHERE pm2_5 IS NOT NULL GROUP BY ALL)""",
    dbl="bin_lo bin_hi",
)
def a16(spark, sf):
    return A.histogram(readings(spark, sf), "pm2_5", 20)


@query(
    "a17_next24_stats",
    f"""WITH {PANEL}, {LAST_HOURS}, {BP} SELECT station, min(aqi) AS low, max(aqi) AS high, avg(aqi) AS mean
FROM (SELECT station, {clamped_sql('pm2_5', 'pm2_5')} AS aqi FROM fc WHERE step_hour <= 24) GROUP BY station""",
    dbl="mean",
)
def a17(spark, sf):
    fc = X._last_hours(panel_hourly(spark, sf))
    scored = fc.select("station", F.col("step_hour").alias("h"), aqi_clamped(F.col("pm2_5"), "pm2_5").alias("aqi"))
    return A.next24_stats(scored)


_IND = [f"{p}_individual_aqi" for p in ANALYSIS]


@query(
    "a18_near_max_share",
    f"WITH {READINGS}, {BPM}, {INDIVIDUAL_SQL} "
    + " UNION ALL ".join(
        f"SELECT station, '{p}_individual_aqi' AS \"column\", count(*) FILTER (m > 0 AND a_{p} >= m * 0.9) AS n, "
        f"count(*) FILTER (m > 0 AND a_{p} >= m * 0.9) * 100.0::DOUBLE / count(*) AS percent FROM indiv GROUP BY station"
        for p in ANALYSIS
    ),
    dbl="percent",
)
def a18(spark, sf):
    return A.near_max_share(individual(readings(spark, sf)), _IND)


@query(
    "a19_aqi_gap_stats",
    f"""WITH {READINGS}, {BP}, {BPM}, {AQI_SQL}, g AS (SELECT station, greatest({", ".join(analysis_sql(p) for p in ANALYSIS)}) - us_aqi AS gap FROM aqis)
SELECT station, count(*) FILTER (gap > 10) AS underestimated, max(gap) AS max_gap, avg(gap) AS mean_gap, stddev_samp(gap) AS std_gap, count(gap) AS n
FROM g GROUP BY station""",
    dbl="mean_gap std_gap",
)
def a19(spark, sf):
    d = individual(with_aqi(readings(spark, sf))).withColumn("full_aqi", F.greatest(*_IND))
    return A.aqi_gap_stats(d, "full_aqi", "us_aqi")


_LIMITS = {"temperature": (2, "Cool", "Hot"), "humidity": (10, "Dry", "Humid"), "wind_speed": (1, "Calm air", "Windy"),
           "pressure": (2, "Low", "High")}


@query(
    "a20_contrast_means",
    f"WITH {READINGS} "
    + " UNION ALL ".join(
        f"""SELECT *, CASE WHEN difference < -{n} THEN '{lo}' WHEN abs(difference) < {n} THEN 'Normal' WHEN difference IS NOT NULL THEN '{hi}' END AS label
FROM (SELECT station, '{c}' AS "column", avg({c}) FILTER (pm2_5 > 60) AS inside, avg({c}) FILTER (pm2_5 <= 60 OR pm2_5 IS NULL) AS outside,
inside - outside AS difference FROM readings GROUP BY station)"""
        for c, (n, lo, hi) in _LIMITS.items()
    ),
    dbl="inside outside difference",
)
def a20(spark, sf):
    r = readings(spark, sf).withColumn("high", F.col("pm2_5") > 60)
    return A.contrast_means(r, "high", list(_LIMITS))


_POLL = ["carbon_monoxide", "ozone", "nh3"]
_WX = ["temperature", "humidity", "wind_speed"]
_HZ = [1, 6, 24]


def lead_corr_sql(feats, targets, horizons, src: str = "panel") -> str:
    """CTE ll(station, x, target, h, r, n) by joins on time."""
    parts = []
    for h in horizons:
        for t in targets:
            for f in feats:
                parts.append(
                    f"SELECT a.station, '{f}' AS x, '{t}' AS target, {h} AS h, corr(a.{f}, b.{t}) AS r, "
                    f"count(*) FILTER (a.{f} IS NOT NULL AND b.{t} IS NOT NULL) AS n FROM {src} a JOIN {src} b "
                    f"ON a.station = b.station AND b.time = a.time + to_hours({h}) GROUP BY a.station"
                )
    return "ll AS (" + " UNION ALL ".join(parts) + ")"


_RANK_SQL = (
    "rp AS (SELECT station, x, target, avg(abs(r)) AS avg_abs_r, max(abs(r)) AS max_abs_r FROM ll WHERE r <> 0 GROUP BY ALL)"
)


@query(
    "a21_rank_predictors",
    f"WITH {PANEL}, {lead_corr_sql(_POLL + _WX, ['pm2_5', 'pm10'], _HZ)}, {_RANK_SQL} SELECT *, CASE WHEN avg_abs_r > 0.3 THEN 'TIER 1' "
    "WHEN avg_abs_r > 0.2 THEN 'TIER 2' WHEN avg_abs_r > 0.1 THEN 'TIER 3' ELSE 'TIER 4' END AS tier FROM rp",
    dbl="avg_abs_r max_abs_r",
)
def a21(spark, sf):
    ll = lead_lag_corr(panel_hourly(spark, sf), _POLL + _WX, ["pm2_5", "pm10"], _HZ)
    return A.rank_predictors(ll, target="target")


_IN = lambda cols: ", ".join(f"'{c}'" for c in cols)


@query(
    "a21b_group_verdict",
    f"""WITH {PANEL}, {lead_corr_sql(_POLL + _WX, ['pm2_5', 'pm10'], _HZ)}, {_RANK_SQL},
v AS (SELECT station, count(*) FILTER (x IN ({_IN(_POLL)}) AND m > 0.2) AS strong_pollutants, count(*) FILTER (x IN ({_IN(_WX)}) AND m > 0.2) AS strong_weather
FROM (SELECT station, x, max(avg_abs_r) AS m FROM rp GROUP BY ALL) GROUP BY station)
SELECT *, CASE WHEN strong_pollutants > strong_weather THEN 'pollutants' WHEN strong_weather > strong_pollutants THEN 'weather' ELSE 'both' END AS verdict FROM v""",
)
def a21b(spark, sf):
    ll = lead_lag_corr(panel_hourly(spark, sf), _POLL + _WX, ["pm2_5", "pm10"], _HZ)
    return A.group_verdict(A.rank_predictors(ll, target="target"), {"pollutants": _POLL, "weather": _WX})
