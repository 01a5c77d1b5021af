"""Lags, range statistics, fills and shifts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from breezeframe.catalog.registry import query
from breezeframe.fixtures import PANEL, READINGS, panel_hourly, readings
from breezeframe.operators import frames as R
from breezeframe.operators import windows as W
from breezeframe.schema import MEASURES, ROW_CHANGES


def lag_sql(column: str, hours: int, minutes: int, src: str = "readings") -> str:
    """Nearest row to ``hours`` ago by inequality join and ranking; one row per (station, seq)."""
    return f"""
  SELECT station, seq, v FROM (
    SELECT a.station, a.seq, b.{column} AS v,
           row_number() OVER (PARTITION BY a.station, a.seq ORDER BY
             abs(epoch_us(b.time) - (epoch_us(a.time) - {hours}::BIGINT * 3600000000)), b.time, b.seq) AS rn
    FROM {src} a JOIN {src} b ON a.station = b.station
     AND b.time BETWEEN a.time - INTERVAL {hours} HOUR - INTERVAL {minutes} MINUTE
                    AND a.time - INTERVAL {hours} HOUR + INTERVAL {minutes} MINUTE)
  WHERE rn = 1"""


def lags_sql(specs, src: str = "readings", extra: str = "") -> str:
    ctes = ",\n".join(
        f"l{i} AS ({lag_sql(s.column, s.hours, s.tolerance, src)})" for i, s in enumerate(specs)
    )
    cols = ", ".join(f"l{i}.v AS {s.name}" for i, s in enumerate(specs))
    joins = " ".join(f"LEFT JOIN l{i} USING (station, seq)" for i in range(len(specs)))
    return f"""WITH {READINGS}, {ctes}
SELECT r.station, r.seq, r.time, {cols} FROM readings r {joins}"""


@query("j5_asof_lag", lags_sql([W.Lag("pm2_5_lag_1h", "pm2_5", 1)]))
def j5(spark, sf):
    r = readings(spark, sf).select("station", "seq", "time", "pm2_5")
    return W.asof_lag(r, "pm2_5", 1, 30, "pm2_5_lag_1h").drop("pm2_5")


@query("w1_tolerance_lags", lags_sql(W.target_lags()))
def w1(spark, sf):
    r = readings(spark, sf).select("station", "seq", "time", "pm2_5", "pm10")
    return W.window_features(r, lags=W.target_lags()).drop("pm2_5", "pm10")


def rolling_sql(specs) -> str:
    f = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    cols = ", ".join(
        f"CASE WHEN count(*) OVER w{s.hours} >= 2 THEN {f[s.stat]}({s.column}) OVER w{s.hours} END AS {s.name}"
        for s in specs
    )
    wins = ", ".join(
        f"w{h} AS (PARTITION BY station ORDER BY time RANGE BETWEEN INTERVAL {h} HOURS PRECEDING AND CURRENT ROW)"
        for h in sorted({s.hours for s in specs})
    )
    return f"WITH {READINGS} SELECT station, seq, time, {cols} FROM readings WINDOW {wins}"


_ROLL = W.target_rolling()


@query("w3_rolling", rolling_sql(_ROLL), dbl=" ".join(s.name for s in _ROLL))
def w3(spark, sf):
    r = readings(spark, sf).select("station", "seq", "time", "pm2_5", "pm10")
    return W.window_features(r, rolls=_ROLL).drop("pm2_5", "pm10")


@query("w2_extra_lags", lags_sql(W.extra_lags()))
def w2(spark, sf):
    lags = W.extra_lags()
    src = list(dict.fromkeys(s.column for s in lags))
    r = readings(spark, sf).select("station", "seq", "time", *src)
    return W.window_features(r, lags=lags).drop(*src)


_ROLL4 = W.extra_rolling()


@query("w4_extra_rolling", rolling_sql(_ROLL4), dbl=" ".join(s.name for s in _ROLL4))
def w4(spark, sf):
    src = list(dict.fromkeys(s.column for s in _ROLL4))
    r = readings(spark, sf).select("station", "seq", "time", *src)
    return W.window_features(r, rolls=_ROLL4).drop(*src)


def changes_sql(specs) -> str:
    lags = [W.Lag(s.name, s.column, s.hours) for s in specs]
    cols = ", ".join(
        f"CASE WHEN p.{s.name} <> 0 THEN (r.{s.column} - p.{s.name}) / p.{s.name} END AS {s.name}" for s in specs
    )
    inner = lags_sql(lags).replace("WITH", "", 1)
    head, body = inner.rsplit("\nSELECT", 1)
    return f"WITH {head}, p AS (SELECT {body}) SELECT r.station, r.seq, r.time, {cols} FROM readings r JOIN p USING (station, seq)"


_CHG = W.target_changes()


@query("w5_change_rate", changes_sql(_CHG), dbl=" ".join(s.name for s in _CHG))
def w5(spark, sf):
    r = readings(spark, sf).select("station", "seq", "time", "pm2_5", "pm10")
    return W.window_features(r, changes=_CHG).drop("pm2_5", "pm10")


def pct_sql(cols: dict[str, str]) -> str:
    """CTE pct over readings: forward-filled value against the forward-filled previous row."""
    src = list(dict.fromkeys(cols.values()))
    fill = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER (PARTITION BY station ORDER BY time, seq ROWS UNBOUNDED PRECEDING) AS f_{c}" for c in src
    )
    prev = ", ".join(f"lag(f_{c}) OVER (PARTITION BY station ORDER BY time, seq) AS p_{c}" for c in src)
    out = ", ".join(f"CASE WHEN p_{c} <> 0 THEN f_{c} / p_{c} - 1 END AS {n}" for n, c in cols.items())
    return f"pct AS (SELECT station, seq, time, {out} FROM (SELECT *, {prev} FROM (SELECT *, {fill} FROM readings)))"


@query("w6_pct_change", f"WITH {READINGS}, {pct_sql(ROW_CHANGES)} SELECT * FROM pct", dbl=" ".join(ROW_CHANGES))
def w6(spark, sf):
    r = readings(spark, sf).select("station", "seq", "time", *dict.fromkeys(ROW_CHANGES.values()))
    return W.pct_change(r, ROW_CHANGES).select("station", "seq", "time", *ROW_CHANGES)


_PAST = {f"pm2_5_past_{k}h": ("pm2_5", k) for k in (1, 6, 24)}


@query(
    "w7_shift",
    f"WITH {PANEL} SELECT station, time, "
    + ", ".join(f"lag({c}, {k}) OVER w AS {n}" for n, (c, k) in _PAST.items())
    + " FROM panel WINDOW w AS (PARTITION BY station ORDER BY time)",
)
def w7(spark, sf):
    p = panel_hourly(spark, sf).select("station", "time", "seq", "pm2_5")
    return W.shift(p, _PAST).drop("seq", "pm2_5")


_HZ = [1, 6, 12, 24, 48, 72]


@query(
    "w8_targets",
    f"WITH {PANEL} SELECT station, time, "
    + ", ".join(f"lead({c}, {h}) OVER w AS {c}_target_{h}h" for c in ("pm2_5", "pm10") for h in _HZ)
    + " FROM panel WINDOW w AS (PARTITION BY station ORDER BY time)",
)
def w8(spark, sf):
    p = panel_hourly(spark, sf).select("station", "time", "seq", "pm2_5", "pm10")
    return R.targets(p, horizons=_HZ).drop("seq", "pm2_5", "pm10")


@query(
    "w10_fill_gaps",
    f"WITH {READINGS} SELECT station, seq, time, "
    + ", ".join(
        f"""coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY station ORDER BY time, seq ROWS UNBOUNDED PRECEDING),
first_value({c} IGNORE NULLS) OVER (PARTITION BY station ORDER BY time, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS {c}"""
        for c in ("pm2_5", "wind_direction", "ozone")
    )
    + ", CASE WHEN seq % 3 = 0 THEN pm10 END AS pm10_lag_1h FROM readings",
)
def w10(spark, sf):
    lagged = F.when(F.col("seq") % 3 == 0, F.col("pm10")).alias("pm10_lag_1h")
    return W.fill_gaps(readings(spark, sf).select("station", "seq", "time", "pm2_5", "wind_direction", "ozone", lagged))


@query(
    "w11_time_gaps",
    f"""WITH {READINGS}, g AS (SELECT station, lag(time) OVER (PARTITION BY station ORDER BY time, seq) AS gap_start,
time AS gap_end FROM readings) SELECT station, gap_start, gap_end,
(epoch_us(gap_end) - epoch_us(gap_start)) / 3600000000.0 AS gap_hours FROM g WHERE gap_end - gap_start > INTERVAL 2 HOUR""",
    dbl="gap_hours",
)
def w11(spark, sf):
    return W.time_gaps(readings(spark, sf).select("station", "seq", "time"))


_EXOG = ["temperature", "humidity", "wind_direction_sin", "wind_direction_cos", "nh3", "hour_sin", "hour_cos"]
_EXOG_H = [1, 24, 72]


@query(
    "w9_exog_at_horizon",
    f"""WITH {PANEL}, e AS (SELECT *, sin(2 * pi() * hour(time) / 24.0) AS hour_sin, cos(2 * pi() * hour(time) / 24.0) AS hour_cos,
round_even(sin(radians(wind_direction)), 10) AS wind_direction_sin, round_even(cos(radians(wind_direction)), 10) AS wind_direction_cos FROM panel)
SELECT station, time, """
    + ", ".join(f"lead({c}, {h}) OVER w AS {c}_target_{h}h" for h in _EXOG_H for c in _EXOG)
    + " FROM e WINDOW w AS (PARTITION BY station ORDER BY time)",
    dbl=" ".join(f"{c}_target_{h}h" for h in _EXOG_H for c in _EXOG),
)
def w9(spark, sf):
    from breezeframe.functions.features import cyclic_time, wind_vector

    p = cyclic_time(wind_vector(panel_hourly(spark, sf))).select("station", "time", "seq", *_EXOG)
    return R.exog_at_horizon(p, _EXOG_H, _EXOG).drop("seq", *_EXOG)


_TREE_EXOG = [
    "temperature", "temperature_scaled", "humidity", "pressure", "wind_speed", "wind_direction", "carbon_monoxide", "ozone",
    "sulphur_dioxide", "nh3", "is_hot", "hour_sin", "temp_humidity_interaction", "temp_humidity_interaction_scaled",
]


@query(
    "w9b_tree_exog",
    f"""WITH {PANEL}, e AS (SELECT *, temperature / 10 AS temperature_scaled, CASE WHEN temperature > 35 THEN 1 ELSE 0 END AS is_hot,
sin(2 * pi() * hour(time) / 24.0) AS hour_sin, temperature * humidity AS temp_humidity_interaction,
temperature * humidity / 100 AS temp_humidity_interaction_scaled FROM panel)
SELECT station, time, """
    + ", ".join(f"lead({c}, {h}) OVER w AS {c}_target_{h}h" for h in (1, 24) for c in _TREE_EXOG)
    + " FROM e WINDOW w AS (PARTITION BY station ORDER BY time)",
    dbl=" ".join(f"{c}_target_{h}h" for h in (1, 24) for c in _TREE_EXOG if c != "is_hot"),
)
def w9b(spark, sf):
    t = F.col("temperature")
    p = panel_hourly(spark, sf).withColumns({
        "temperature_scaled": t / 10, "is_hot": F.when(t > 35, 1).otherwise(0),
        "hour_sin": F.sin(F.hour("time") * (2 * math.pi / 24)), "temp_humidity_interaction": t * F.col("humidity"),
        "temp_humidity_interaction_scaled": t * F.col("humidity") / 100,
    })
    cols = R.tree_exogenous_columns(p)
    return R.exog_at_horizon(p.select("station", "time", "seq", *cols), [1, 24], cols).drop("seq", *cols)


_SEQ_LEN, _STEPS = 24, 6
_NUMBERED = "np AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY time) - 1 AS i, count(*) OVER (PARTITION BY station) AS n FROM panel)"


@query(
    "w12_encoder_windows",
    f"""WITH {PANEL}, {_NUMBERED},
s AS (SELECT station, time, i AS base, n,
 sum(pm2_5) OVER e AS enc_pm2_5, count(pm2_5) OVER e AS enc_known, sum(temperature) OVER e AS enc_temperature,
 count(*) OVER e AS enc_rows, sum(pm10) OVER t AS target_pm10, count(*) OVER t AS target_rows
 FROM np WINDOW e AS (PARTITION BY station ORDER BY time ROWS BETWEEN {_SEQ_LEN} PRECEDING AND 1 PRECEDING),
 t AS (PARTITION BY station ORDER BY time ROWS BETWEEN 1 FOLLOWING AND {_STEPS} FOLLOWING))
SELECT station, time, base, coalesce(enc_pm2_5, 0) AS enc_pm2_5, enc_known, coalesce(enc_temperature, 0) AS enc_temperature,
 enc_rows, coalesce(target_pm10, 0) AS target_pm10, target_rows FROM s WHERE base >= {_SEQ_LEN} AND base < n - {_STEPS}""",
    dbl="enc_pm2_5 enc_temperature target_pm10",
)
def w12(spark, sf):
    p = panel_hourly(spark, sf).select("station", "time", "seq", "pm2_5", "pm10", "temperature")
    w = R.encoder_windows(p, ["pm2_5", "temperature"], _SEQ_LEN, _STEPS)

    def total(col, i):
        return F.aggregate(col, F.lit(0.0), lambda a, x: a + F.coalesce(x[i], F.lit(0.0)))

    return w.select(
        "station", "time", "base",
        total("encoder", 0).alias("enc_pm2_5"),
        F.size(F.filter("encoder", lambda x: x[0].isNotNull())).cast("bigint").alias("enc_known"),
        total("encoder", 1).alias("enc_temperature"),
        F.size("encoder").cast("bigint").alias("enc_rows"),
        total("targets", 1).alias("target_pm10"),
        F.size("targets").cast("bigint").alias("target_rows"),
    )


@query(
    "w13_target_windows",
    f"""WITH {PANEL}, {_NUMBERED} SELECT b.station, b.i AS base, CAST(t.i - b.i AS INTEGER) AS h, t.pm2_5, t.pm10
FROM np b JOIN np t ON b.station = t.station AND t.i BETWEEN b.i + 1 AND b.i + {_STEPS}
WHERE b.i >= {_SEQ_LEN} AND b.i < b.n - {_STEPS}""",
)
def w13(spark, sf):
    p = panel_hourly(spark, sf).select("station", "time", "seq", "pm2_5", "pm10")
    return R.target_windows(p, _SEQ_LEN, _STEPS)


@query(
    "w14_teacher_pairs",
    f"""WITH {PANEL}, {_NUMBERED} SELECT b.station, b.time, CAST(h AS INTEGER) AS h, p.pm2_5 AS prev_pm2_5, p.pm10 AS prev_pm10,
t.pm2_5 AS target_pm2_5, t.pm10 AS target_pm10 FROM (SELECT *, unnest(range(1, {_STEPS + 1})) AS h FROM np) b
LEFT JOIN np p ON p.station = b.station AND p.i = b.i + h - 1 LEFT JOIN np t ON t.station = b.station AND t.i = b.i + h""",
)
def w14(spark, sf):
    return R.teacher_pairs(panel_hourly(spark, sf).select("station", "time", "seq", "pm2_5", "pm10"), _STEPS)


@query(
    "w15_horizon_tensor",
    f"""WITH {PANEL}, x AS (SELECT station, time, feature, v FROM panel UNPIVOT INCLUDE NULLS (v FOR feature IN (temperature, humidity, nh3)))
SELECT b.station, b.time, CAST(h AS INTEGER) AS h, b.feature, coalesce(t.v, 0) AS value
FROM (SELECT *, unnest([1, 12, 72]) AS h FROM x) b LEFT JOIN x t
ON t.station = b.station AND t.feature = b.feature AND t.time = b.time + to_hours(h)""",
)
def w15(spark, sf):
    return R.horizon_tensor(panel_hourly(spark, sf), [1, 12, 72], ["temperature", "humidity", "nh3"])


@query(
    "w17_dedupe_last",
    f"""WITH {READINGS} SELECT station, date_trunc('hour', time) AS hour, max(seq) AS seq, arg_max(pm10, seq) AS pm10 FROM readings GROUP BY ALL""",
)
def w17(spark, sf):
    r = readings(spark, sf).select("station", F.date_trunc("hour", "time").alias("hour"), "seq", "pm10")
    return W.dedupe_last(r, ["station", "hour"], ["seq"])


_DRAW = "(('0x' || substr(md5(station || '|' || epoch_us(time)::VARCHAR || '|nh3|' || h::VARCHAR || '|{tag}7'), 1, 10))::BIGINT + 0.5) / 1099511627776.0"


@query(
    "w18_ar1_noise",
    f"""WITH {PANEL}, b AS (SELECT station, time, unnest(range(1, 73)) AS h FROM panel),
z AS (SELECT station, time, h, (0.05 + (h - 1) * (0.25 / 71)) * sqrt(-2 * ln({_DRAW.format(tag='u')})) * cos(2 * pi() * {_DRAW.format(tag='v')}) AS z FROM b),
e AS (SELECT station, time, h, pow(0.8::DOUBLE, h) * sum(z * pow(0.8::DOUBLE, -h)) OVER (PARTITION BY station, time ORDER BY h) AS e FROM z)
SELECT e.station, e.time, CAST(h AS INTEGER) AS h, p.nh3 + e AS nh3
FROM e LEFT JOIN panel p ON p.station = e.station AND p.time = e.time + to_hours(h)""",
    dbl="nh3",
)
def w18(spark, sf):
    noisy = R.ar1_noise(R.horizon_arrays(panel_hourly(spark, sf), ["nh3"], 72), ["nh3"], 0.05, 0.30, 72)
    return noisy.select("station", "time", F.posexplode("nh3").alias("h", "nh3")).withColumn("h", F.col("h") + 1)
