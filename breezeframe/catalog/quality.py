"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeframe.catalog.aggregates import stack
from breezeframe.catalog.registry import query
from breezeframe.catalog.scalars import THRESHOLD_SQL, cyclic_sql, flags_sql
from breezeframe.fixtures import PANEL, READINGS, panel_hourly, readings
from breezeframe.functions import features as G
from breezeframe.operators import frames as R
from breezeframe.operators import quality as Q
from breezeframe.schema import CYCLIC_COLUMNS, MEASURES, RANGE_RULES, THRESHOLDS
from breezeframe.sources.tables import require, require_rows

ORDER_SQL = """SELECT station, count(*) FILTER (pm2_5 > pm10) AS violations, count(*) FILTER (pm2_5 > pm10) * 100.0::DOUBLE / count(*) AS percent,
max(pm2_5 - pm10) FILTER (pm2_5 > pm10) AS max_excess FROM readings GROUP BY station"""


@query("d1_order_check", f"WITH {READINGS} {ORDER_SQL}", dbl="percent max_excess")
def d1(spark, sf):
    return Q.order_check(readings(spark, sf))


def range_sql(rules, src: str = "readings") -> str:
    return " UNION ALL ".join(
        f"""SELECT station, '{c}' AS "column", count(*) FILTER ({c} < {lo}) AS below, count(*) FILTER ({c} > {hi}) AS above, min({c}) AS "min",
max({c}) AS "max", count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS violations FROM {src} GROUP BY station"""
        for c, (lo, hi) in rules.items()
    )


@query("d2_range_check", f"WITH {READINGS} {range_sql(RANGE_RULES)}")
def d2(spark, sf):
    return Q.range_check(readings(spark, sf))


@query(
    "d3_bounds_check",
    f"WITH {READINGS}, c AS (SELECT station, {cyclic_sql()} FROM readings) {range_sql({c: (-1.01, 1.01) for c in CYCLIC_COLUMNS}, 'c')}",
    dbl="min max",
)
def d3(spark, sf):
    return Q.bounds_check(G.cyclic_time(readings(spark, sf)))


@query(
    "d4_domain_check",
    f"WITH {READINGS}, f AS (SELECT station, CASE WHEN seq % 19 = 0 THEN NULL WHEN seq % 31 = 0 THEN 2 ELSE 1 END AS is_hot, "
    "CASE WHEN pm10 > 50 THEN 1 ELSE 0 END AS is_high_pm10 FROM readings) "
    + stack(["is_hot", "is_high_pm10"], "count(*) FILTER ({c} IS NULL OR {c} NOT IN (0, 1)) AS unexpected, count(*) FILTER ({c} IS NULL) AS nulls", "f"),
)
def d4(spark, sf):
    i = F.col("seq")
    r = readings(spark, sf).select(
        "station",
        F.when(i % 19 == 0, F.lit(None)).when(i % 31 == 0, 2).otherwise(1).alias("is_hot"),
        F.when(F.col("pm10") > 50, 1).otherwise(0).alias("is_high_pm10"),
    )
    return Q.domain_check(r)


ZCOLS = ["pm2_5", "pm10", "sulphur_dioxide", "temperature"]


def z_sql(cols, src: str = "readings") -> str:
    return " UNION ALL ".join(
        f"""SELECT station, '{c}' AS "column", count(*) FILTER (z > 3) AS outliers, count(*) FILTER (z > 3) * 100.0::DOUBLE / count(z) AS percent,
max(z) AS max_abs_z FROM (SELECT station, abs(({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w) AS z FROM {src} WINDOW w AS (PARTITION BY station)) GROUP BY station"""
        for c in cols
    )


@query("d5_zscore_report", f"WITH {READINGS} {z_sql(ZCOLS)}", dbl="percent max_abs_z")
def d5(spark, sf):
    return Q.zscore_report(readings(spark, sf), ZCOLS)


def iqr_sql(cols, src: str = "readings") -> str:
    return " UNION ALL ".join(
        f"""SELECT station, '{c}' AS "column", count(*) FILTER ({c} < lo OR {c} > hi) AS outliers,
count(*) FILTER ({c} < lo OR {c} > hi) * 100.0::DOUBLE / count({c}) AS percent, max(lo) AS lower_fence, max(hi) AS upper_fence
FROM {src} JOIN (SELECT station, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT station,
quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src} GROUP BY station)) USING (station) GROUP BY station"""
        for c in cols
    )


@query("d6_iqr_report", f"WITH {READINGS} {iqr_sql(ZCOLS)}", dbl="percent lower_fence upper_fence")
def d6(spark, sf):
    return Q.iqr_report(readings(spark, sf), ZCOLS)


_MISS = " + ".join(f"(count(*) - count({c}))" for c in MEASURES)


@query(
    "d7_quality_score",
    f"""WITH {READINGS}, x AS (SELECT *, {cyclic_sql()}, {flags_sql(THRESHOLD_SQL)} FROM readings),
o AS ({ORDER_SQL}), r AS ({range_sql(RANGE_RULES)}), z AS ({z_sql(ZCOLS)}), q AS ({iqr_sql(ZCOLS)}),
m AS (SELECT station, ({_MISS}) * 100.0::DOUBLE / (count(*) * {len(MEASURES)}) AS missing_percent FROM readings GROUP BY station),
d AS (SELECT station, sum(c - 1) * 100.0::DOUBLE / sum(c) AS duplicate_percent FROM (SELECT station, temperature, wind_speed, count(*) AS c FROM readings GROUP BY ALL) GROUP BY station),
p AS (SELECT m.*, duplicate_percent, (SELECT count(*) FILTER (violations > 0) FROM r WHERE r.station = m.station) AS range_columns,
 (SELECT count(*) FILTER (outliers > 0) FROM z WHERE z.station = m.station) AS z_columns,
 (SELECT count(*) FILTER (outliers > 0) FROM q WHERE q.station = m.station) AS iqr_columns, o.percent AS order_percent,
 (SELECT CAST(count(*) FILTER (seq % 97 = 0) > 0 AS BIGINT) FROM readings r WHERE r.station = m.station) AS cyclic_columns,
 (SELECT CAST(count(*) FILTER (seq % 89 = 0) > 0 AS BIGINT) FROM readings r WHERE r.station = m.station) AS flag_columns FROM m JOIN d USING (station) JOIN o USING (station))
SELECT *, CASE WHEN score >= 90 THEN 'EXCELLENT' WHEN score >= 75 THEN 'GOOD' WHEN score >= 60 THEN 'ACCEPTABLE' ELSE 'POOR' END AS status
FROM (SELECT *, greatest(0, 100 - least(20, missing_percent * 4) - least(10, duplicate_percent * 2) - range_columns * 2 - cyclic_columns * 3 - flag_columns * 2
 - least(15, order_percent * 3) - least(5, (z_columns + iqr_columns) * 0.5::DOUBLE)) AS score FROM p)""",
    dbl="missing_percent duplicate_percent order_percent score",
)
def d7(spark, sf):
    x = G.threshold_flags(G.cyclic_time(readings(spark, sf)))
    # some rows break a cyclic column and a flag
    spoilt = lambda c, n, v: F.when(F.col("seq") % n == 0, F.lit(v).cast(x.schema[c].dataType)).otherwise(F.col(c))
    x = x.withColumns({"hour_sin": spoilt("hour_sin", 97, 2), "is_hot": spoilt("is_hot", 89, 3)})
    return Q.quality_score(x, MEASURES, ZCOLS, duplicate_cols=["temperature", "wind_speed"])


@query(
    "d8_target_readiness",
    f"""WITH {READINGS}, z AS ({z_sql(['pm2_5', 'sulphur_dioxide'])}),
o AS ({stack(['pm2_5', 'sulphur_dioxide'], "count(*) FILTER ({c} = 0) * 100.0::DOUBLE / count(*) AS zero_percent")})
SELECT station, "column", percent AS outlier_percent, zero_percent,
CAST(100 - CASE WHEN percent > 5 THEN 10 ELSE 0 END - CASE WHEN zero_percent > 10 THEN 15 ELSE 0 END AS INTEGER) AS readiness,
100 - CASE WHEN percent > 5 THEN 10 ELSE 0 END - CASE WHEN zero_percent > 10 THEN 15 ELSE 0 END >= 70 AS ready
FROM z JOIN o USING (station, "column")""",
    dbl="outlier_percent zero_percent",
)
def d8(spark, sf):
    return Q.target_readiness(readings(spark, sf), ["pm2_5", "sulphur_dioxide"])


@query(
    "d9_outlier_context",
    f"""WITH {READINGS}, f AS (SELECT station, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT station, quantile_cont(pm2_5, 0.25) AS q1,
quantile_cont(pm2_5, 0.75) AS q3 FROM readings GROUP BY station)),
m AS (SELECT r.*, coalesce(pm2_5 > hi, false) AS o FROM readings r JOIN f USING (station)),
c AS (SELECT station, count(*) FILTER (o) AS outliers,
 count(*) FILTER (o AND hour(time) IN (7, 8, 9, 17, 18, 19)) / (count(*) FILTER (o))::DOUBLE AS rush_share,
 avg(wind_speed) FILTER (o) - avg(wind_speed) FILTER (NOT o) AS wind_difference,
 avg(humidity) FILTER (o) - avg(humidity) FILTER (NOT o) AS humidity_difference,
 avg(temperature) FILTER (o) - avg(temperature) FILTER (NOT o) AS temperature_difference FROM m GROUP BY station)
SELECT *, CASE WHEN legitimacy >= 0.7 THEN 'likely real' WHEN legitimacy >= 0.4 THEN 'mixed' ELSE 'likely sensor errors' END AS assessment,
rush_share > 0.3 AS rush_hour_linked FROM (SELECT *, ((wind_difference < 0)::INT + (humidity_difference > 5)::INT + (abs(temperature_difference) > 3)::INT) / 3.0::DOUBLE AS legitimacy FROM c WHERE outliers > 0)""",
    dbl="rush_share wind_difference humidity_difference temperature_difference legitimacy",
)
def d9(spark, sf):
    return Q.outlier_context(readings(spark, sf))


@query(
    "d10_alignment_report",
    f"""WITH {PANEL}, n AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY time) <= floor(0.8::DOUBLE * count(*) OVER (PARTITION BY station)) AS is_train FROM panel)
SELECT *, feature_min < -10 OR feature_max > 10 AS range_suspicious, coalesce(abs(mean_pm2_5) > 100, false) OR coalesce(abs(mean_pm10) > 200, false) AS targets_suspicious, feature_nulls = 0 AND n_pm2_5 = rows AND n_pm10 = rows AS aligned
FROM (SELECT station, is_train, count(*) AS rows, count(pm2_5) AS n_pm2_5, count(pm10) AS n_pm10, avg(pm2_5) AS mean_pm2_5, avg(pm10) AS mean_pm10,
min(least(temperature, nh3)) AS feature_min, max(greatest(temperature, nh3)) AS feature_max,
CAST(sum((temperature IS NULL)::INT + (nh3 IS NULL)::INT) AS BIGINT) AS feature_nulls FROM n GROUP BY ALL)""",
    dbl="mean_pm2_5 mean_pm10",
)
def d10(spark, sf):
    p = R.chrono_split(panel_hourly(spark, sf), 0.2)
    return Q.alignment_report(p, ["temperature", "nh3"])


@query(
    "d11_require",
    f"WITH {PANEL} SELECT station, time, pm2_5 FROM panel",
)
def d11(spark, sf):
    p = require(panel_hourly(spark, sf), ["station", "time", "pm2_5"])
    span = p.groupBy("station").agg(
        ((F.max("seq") - F.min("seq")) / 3600 + 1).cast("bigint").alias("expected")
    )
    return require_rows(p.join(span, "station"), "expected").select("station", "time", "pm2_5")
