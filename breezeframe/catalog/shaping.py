"""Selection, joins, sets, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeframe import fixtures as X
from breezeframe.catalog.registry import query
from breezeframe.catalog.scalars import BP, strict_sql
from breezeframe.catalog.sources import MONITOR_SQL
from breezeframe.fixtures import LAST_HOURS, PANEL, PREDICTIONS, READINGS, panel_hourly, readings
from breezeframe.functions import features as G
from breezeframe.functions.aqi import aqi_lookup, breakpoint_table
from breezeframe.operators import joins as J
from breezeframe.operators import shaping as S
from breezeframe.operators import windows as W
from breezeframe.schema import CLEAN_FEATURES, IQR_COLUMNS, MEASURES

KEY = ["station", "seq"]


@query(
    "p1_normalise_names",
    f"WITH {READINGS} SELECT station, seq, carbon_monoxide, nitrogen_dioxide, ozone, sulphur_dioxide FROM readings",
)
def p1(spark, sf):
    short = {"carbon_monoxide": "co", "nitrogen_dioxide": "no2", "ozone": "o3", "sulphur_dioxide": "so2"}
    return S.normalise_names(readings(spark, sf).select(*KEY, *short).withColumnsRenamed(short))


@query("p2_ensure_columns", f"WITH {READINGS} SELECT station, seq, no, CAST(NULL AS DOUBLE) AS nh4 FROM readings")
def p2(spark, sf):
    return S.ensure_columns(readings(spark, sf).select(*KEY, "no"), ["no", "nh4"])


@query(
    "p3_with_location",
    f"WITH {READINGS} SELECT station, seq, 'Somewhere' AS city, 12.25::DOUBLE AS latitude, 34.5::DOUBLE AS longitude FROM readings",
)
def p3(spark, sf):
    return S.with_location(readings(spark, sf).select(*KEY), "Somewhere", 12.25, 34.5)


@query(
    "p4_cast_schema",
    f"WITH {READINGS} SELECT station, seq, CAST(pm2_5 > 35 AS BIGINT) AS is_high_pm2_5, CAST(hour(time) AS DOUBLE) AS hour FROM readings",
)
def p4(spark, sf):
    r = readings(spark, sf).select(
        *KEY, (F.col("pm2_5") > 35).cast("int").alias("is_high_pm2_5"), F.hour("time").alias("hour")
    )
    return S.cast_schema(r)


@query("p5_drop_static", f"WITH {READINGS} SELECT station, seq, pm2_5 FROM readings")
def p5(spark, sf):
    r = S.with_location(readings(spark, sf).select(*KEY, "time", "pm2_5"), "Somewhere", 12.25, 34.5)
    r = r.withColumns({"hour": F.hour("time"), "iqair_aqi": F.lit(1), "abs_deviation": F.lit(2)})
    return S.drop_static(r).drop("time")


_HAVE = [c for c in CLEAN_FEATURES if c in ["time", *MEASURES]]


@query("p6_select_clean", f"WITH {READINGS} SELECT station, {', '.join(_HAVE)} FROM readings")
def p6(spark, sf):
    return S.select_clean(readings(spark, sf))


_LISTED = [c for c in ["station", "seq", *MEASURES] if c not in ("pm2_5", "pm10")]


@query("p7_feature_columns", f"WITH {READINGS} SELECT {', '.join(_LISTED)} FROM readings")
def p7(spark, sf):
    r = readings(spark, sf).withColumn("city", F.lit("x"))
    return r.select(*S.feature_columns(r, also=["time"]))


_ENCODER = (
    "pm2_5, pm10, temperature, humidity, pressure, wind_speed, wind_direction_sin, wind_direction_cos, hour_sin, hour_cos, "
    "day_sin, day_cos, month_sin, month_cos, day_of_week_sin, day_of_week_cos, carbon_monoxide, ozone, sulphur_dioxide, nh3"
)


@query(
    "p7b_model_features",
    f"""WITH {READINGS} SELECT station, seq, {_ENCODER} FROM (SELECT *, round_even(sin(radians(wind_direction)), 10) AS wind_direction_sin,
round_even(cos(radians(wind_direction)), 10) AS wind_direction_cos, """
    + ", ".join(
        f"{f}(2 * pi() * {x} / {n}) AS {c}_{f}" for c, x, n in (
            ("hour", "hour(time)", "24.0"), ("day", "day(time)", "31.0"), ("month", "month(time)", "12.0"),
            ("day_of_week", "(isodow(time) - 1)", "7.0")) for f in ("sin", "cos"))
    + " FROM readings)",
    dbl=_ENCODER.replace(",", ""),
)
def p7b(spark, sf):
    r = G.cyclic_time(G.wind_vector(readings(spark, sf)))
    return r.select("station", "seq", *S.model_features(r, "encoder"))


@query("p8_columns_like", f"WITH {READINGS} SELECT station, seq, pm2_5, pm10, wind_speed, wind_direction FROM readings")
def p8(spark, sf):
    r = readings(spark, sf)
    wind = S.columns_like(r, "wind_", kind="numeric")
    return r.select(*KEY, *S.columns_like(r, prefix="pm"), *wind)


@query("p9_drop_bad_time", f"WITH {READINGS} SELECT station, seq, time FROM readings WHERE seq % 13 <> 0")
def p9(spark, sf):
    r = readings(spark, sf).select(*KEY, F.when(F.col("seq") % 13 != 0, F.col("time")).alias("time"))
    return S.drop_bad_time(r)


@query("p10_keep_positive", f"WITH {READINGS} SELECT station, seq, pm2_5, pm10 FROM readings WHERE pm2_5 > 0 AND pm10 > 0")
def p10(spark, sf):
    return S.keep_positive(readings(spark, sf).select(*KEY, "pm2_5", "pm10"))


@query(
    "p11_drop_nulls",
    f"WITH {READINGS} SELECT station, seq, pm2_5, wind_direction FROM readings WHERE pm2_5 IS NOT NULL AND wind_direction IS NOT NULL",
)
def p11(spark, sf):
    return S.drop_nulls(readings(spark, sf).select(*KEY, "pm2_5", "wind_direction"), ["pm2_5", "wind_direction"])


@query(
    "p12_inf_to_null",
    f"""WITH {READINGS} SELECT station, seq, CASE WHEN sulphur_dioxide <> 0 THEN pm10 / sulphur_dioxide END AS ratio,
CASE WHEN sulphur_dioxide <> 0 THEN pm10 / sulphur_dioxide ELSE 0 END AS served FROM readings""",
    dbl="ratio served",
)
def p12(spark, sf):
    zero = F.col("sulphur_dioxide") == 0
    raw = F.when(zero & (F.col("seq") % 2 == 0), F.lit(float("nan"))).when(zero, F.lit(float("-inf"))).otherwise(
        F.try_divide("pm10", "sulphur_dioxide")
    )
    r = readings(spark, sf).select(*KEY, raw.alias("ratio"), raw.alias("served"))
    return S.inf_to_null(r.withColumn("served", G.finite_or_zero(F.col("served"))))


def iqr_sql(src: str, cols=IQR_COLUMNS, keep: str = "*") -> tuple[str, str]:
    """CTEs of the sequential filter over ``src``; returns them and the last name."""
    ctes, prev = [], src
    for i, c in enumerate(cols):
        ctes.append(
            f"""iq{i} AS (SELECT {prev}.* FROM {prev} JOIN (SELECT station, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3
FROM {prev} GROUP BY station) q USING (station) WHERE {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"""
        )
        prev = f"iq{i}"
    return ", ".join(ctes), prev


_IQR, _IQR_LAST = iqr_sql("readings")


@query("p13_iqr_filter_seq", f"WITH {READINGS}, {_IQR} SELECT station, seq, {', '.join(IQR_COLUMNS)} FROM {_IQR_LAST}")
def p13(spark, sf):
    return S.iqr_filter_seq(readings(spark, sf).select(*KEY, *IQR_COLUMNS))


@query(
    "p14_band_merge",
    f"""WITH {PREDICTIONS} SELECT station, base_time, h, target, CASE WHEN h <= 12 THEN y_pred ELSE y_pred + 1 END AS y_pred
FROM predictions""",
    dbl="y_pred",
)
def p14(spark, sf):
    p = X.predictions(spark, sf).select("station", "base_time", "h", "target", "y_pred")
    return S.band_merge(p, p.withColumn("y_pred", F.col("y_pred") + 1), 12)


# --- joins ---------------------------------------------------------------------------

_SIDES = """a AS (SELECT station, time, pm2_5 FROM panel WHERE hour(time) % 3 <> 0),
b AS (SELECT station, time, temperature FROM panel WHERE hour(time) % 4 <> 0)"""


def _sides(spark, sf):
    p = panel_hourly(spark, sf)
    return (
        p.filter(F.hour("time") % 3 != 0).select("station", "time", "pm2_5"),
        p.filter(F.hour("time") % 4 != 0).select("station", "time", "temperature"),
    )


@query("j1_join_outer", f"WITH {PANEL}, {_SIDES} SELECT * FROM a FULL JOIN b USING (station, time)")
def j1(spark, sf):
    return J.join_outer(*_sides(spark, sf))


@query("j2_join_inner", f"WITH {PANEL}, {_SIDES} SELECT * FROM a JOIN b USING (station, time)")
def j2(spark, sf):
    return J.join_inner(*_sides(spark, sf))


_WX = "temperature, humidity, pressure, wind_speed, wind_direction"
_POL = "carbon_monoxide, ozone, sulphur_dioxide, nh3"


@query(
    "j3_merge_forecasts",
    f"""WITH {PANEL}, {LAST_HOURS} SELECT station, step_hour, time AS target_time, {_WX},
{", ".join(f"CASE WHEN station NOT IN ('click', 'view') THEN {c} END AS {c}" for c in _POL.split(", "))}
FROM fc WHERE step_hour <= 48""",
)
def j3(spark, sf):
    return J.merge_forecasts(X.forecast_weather(spark, sf), X.forecast_pollution(spark, sf), hours=48)


@query("j4_align_offset_join", f"WITH {PANEL}, {LAST_HOURS} SELECT station, step_hour, time AS target_time, {_WX}, {_POL} FROM fc")
def j4(spark, sf):
    return J.align_offset_join(X.forecast_weather(spark, sf), X.forecast_pollution(spark, sf))


@query("j6_aqi_lookup", f"WITH {READINGS}, {BP} SELECT station, seq, {strict_sql('pm10', 'pm10')} AS pm10_aqi FROM readings")
def j6(spark, sf):
    r = readings(spark, sf).select(*KEY, "pm10")
    return aqi_lookup(r, "pm10", "pm10", "pm10_aqi", breakpoint_table(spark)).drop("pm10")


@query(
    "j7_semi_keys",
    f"WITH {PANEL}, {_SIDES} SELECT * FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.station = a.station AND b.time = a.time)",
)
def j7(spark, sf):
    a, b = _sides(spark, sf)
    return J.semi_keys(a, b, ["station", "time"])


@query(
    "j8_only_new",
    f"WITH {PANEL}, {_SIDES} SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.station = a.station AND b.time = a.time)",
)
def j8(spark, sf):
    return J.only_new(*_sides(spark, sf))


@query(
    "j9_align_pairs",
    f"""WITH {PANEL} SELECT a.station, a.time, a.temperature, b.pm2_5 AS pm2_5_future FROM panel a JOIN panel b
ON a.station = b.station AND b.time = a.time + INTERVAL 6 HOUR WHERE a.temperature IS NOT NULL AND b.pm2_5 IS NOT NULL""",
)
def j9(spark, sf):
    p = panel_hourly(spark, sf).select("station", "time", "seq", "temperature", "pm2_5")
    ahead = W.shift(p, {"pm2_5_future": ("pm2_5", -6)})
    return S.drop_nulls(ahead, ["temperature", "pm2_5_future"]).drop("seq", "pm2_5")


@query(
    "j10_cross_scalar",
    f"""WITH {PANEL}, {BP}, {MONITOR_SQL}, last AS (SELECT max(time) AS monitor_time, arg_max(iqair_aqi, (time, station)) AS monitor_aqi
FROM monitor WHERE iqair_aqi IS NOT NULL)
SELECT station, time, pm2_5, (SELECT monitor_aqi FROM last) AS monitor_aqi FROM panel""",
)
def j10(spark, sf):
    m = X.monitor(spark, sf).filter(F.col("iqair_aqi").isNotNull())
    last = m.agg(F.max_by("iqair_aqi", F.struct("time", "station")).alias("monitor_aqi"))
    return J.with_scalar(panel_hourly(spark, sf).select("station", "time", "pm2_5"), last, ["monitor_aqi"])


# --- sets ----------------------------------------------------------------------------


@query(
    "u1_union_history",
    f"""WITH {PANEL} SELECT station, time, pm2_5, temperature FROM panel WHERE day(time) < 20
UNION ALL SELECT station, time, pm2_5, NULL FROM panel WHERE day(time) >= 20""",
)
def u1(spark, sf):
    p = panel_hourly(spark, sf).withColumn("pm2_5_lag_1h", F.lit(0.0))
    old = p.filter(F.dayofmonth("time") < 20).select("station", "time", "pm2_5", "temperature", "pm2_5_lag_1h")
    new = p.filter(F.dayofmonth("time") >= 20).select("station", "time", "pm2_5")
    return J.union_history(old, new)


@query(
    "u2_distinct_rows",
    f"""WITH {READINGS} SELECT station, date_trunc('hour', time) AS time, temperature > 20 AS warm, min(seq) AS seq FROM readings
GROUP BY ALL""",
)
def u2(spark, sf):
    r = readings(spark, sf).select("station", F.date_trunc("hour", "time").alias("time"), (F.col("temperature") > 20).alias("warm"), "seq")
    return J.distinct_rows(r.unionByName(r))


@query("u3_common_keys", f"WITH {PANEL}, {_SIDES} SELECT station, time FROM a INTERSECT SELECT station, time FROM b")
def u3(spark, sf):
    return J.common_keys(*_sides(spark, sf), ["station", "time"])


@query("u4_missing_keys", f"WITH {PANEL}, {_SIDES} SELECT station, time FROM a EXCEPT SELECT station, time FROM b")
def u4(spark, sf):
    return J.missing_keys(*_sides(spark, sf), ["station", "time"])


# --- order and limits ----------------------------------------------------------------


@query("o1_sort_time", f"WITH {READINGS} SELECT station, seq, time, pm2_5 FROM readings")
def o1(spark, sf):
    return J.sort_time(readings(spark, sf).select(*KEY, "time", "pm2_5"))


@query(
    "o2_first_last_n",
    f"""WITH {READINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY time, seq) AS f,
row_number() OVER (PARTITION BY station ORDER BY time DESC, seq DESC) AS l FROM readings)
SELECT station, seq, time, 'first' AS side FROM n WHERE f <= 5 UNION ALL SELECT station, seq, time, 'last' FROM n WHERE l <= 168""",
)
def o2(spark, sf):
    r = readings(spark, sf).select(*KEY, "time")
    first = J.first_n(r, 5).withColumn("side", F.lit("first"))
    return first.unionByName(J.last_n(r, 168).withColumn("side", F.lit("last")))


@query(
    "o5_sample_n",
    f"""WITH {READINGS} SELECT station, seq, pm2_5 FROM readings
ORDER BY substr(md5(concat(station, '|', seq, '|42')), 1, 15), station, seq LIMIT 500""",
)
def o5(spark, sf):
    return J.sample_n(readings(spark, sf).select(*KEY, "pm2_5"), 500, 42)
