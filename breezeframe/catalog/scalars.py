"""Row-wise functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeframe.catalog.registry import query
from breezeframe.fixtures import PANEL, READINGS, panel_hourly, readings
from breezeframe.functions import aqi as A
from breezeframe.functions import features as X
from breezeframe.schema import (
    AQI_CATEGORIES,
    BASE_INTERACTIONS,
    BREAKPOINTS,
    COMPASS,
    CYCLIC_COLUMNS,
    EXTRA_INTERACTIONS,
    MERGED_TOP_BAND,
    POWERS,
    THRESHOLDS,
)

KEY = ["station", "seq"]

# --- rule tables as SQL ---------------------------------------------------------------


def _bp_rows(table) -> str:
    return ", ".join(
        f"('{p}', {lo}::DOUBLE, {hi}::DOUBLE, {il}, {ih}, {i})"
        for p, bands in table.items()
        for i, (lo, hi, il, ih) in enumerate(bands)
    )


MERGED = {p: (b[:-2] + [MERGED_TOP_BAND[p]] if p in MERGED_TOP_BAND else b) for p, b in BREAKPOINTS.items()}
BP = f"bp AS (SELECT * FROM (VALUES {_bp_rows(BREAKPOINTS)}) t(pollutant, c_lo, c_hi, i_lo, i_hi, k))"
BPM = f"bpm AS (SELECT * FROM (VALUES {_bp_rows(MERGED)}) t(pollutant, c_lo, c_hi, i_lo, i_hi, k))"
_INTERP = "CAST(round_even((i_hi - i_lo)::DOUBLE / (c_hi - c_lo) * ({c} - c_lo) + i_lo, 0) AS INTEGER)"


def strict_sql(c: str, p: str, bp: str = "bp") -> str:
    return (
        f"(SELECT max({_INTERP.format(c=c)}) FROM {bp} WHERE pollutant = '{p}' AND {c} BETWEEN c_lo AND c_hi)"
    )


def clamped_sql(c: str, p: str) -> str:
    x = f"greatest(round_even({c} * 10, 0) / 10, 0)" if p == "pm2_5" else f"greatest(round_even({c}, 0), 0)"
    return (
        f"CASE WHEN {c} IS NULL THEN NULL ELSE coalesce((SELECT arg_min({_INTERP.format(c=x)}, k) FROM bp "
        f"WHERE pollutant = '{p}' AND {x} <= c_hi), 500) END"
    )


def category_sql(c: str, field: int = 0) -> str:
    whens = " ".join(f"WHEN {c} <= {cat[2]} THEN '{cat[field]}'" for cat in AQI_CATEGORIES[:-1])
    return f"CASE WHEN {c} IS NULL THEN NULL {whens} ELSE '{AQI_CATEGORIES[-1][field]}' END"


US_AQI_SQL = (
    "CASE WHEN a25 IS NOT NULL AND a10 IS NOT NULL THEN greatest(a25, a10) END"
)

# pollutant -> readings column used for it
STRICT_COLUMNS = {
    "pm2_5": "pm2_5", "pm10": "pm10", "o3_8h": "ozone", "o3_1h": "ozone",
    "co": "sulphur_dioxide", "so2": "sulphur_dioxide", "no2": "nitrogen_dioxide",
}


@query(
    "f1_aqi_strict",
    f"WITH {READINGS}, {BP} SELECT station, seq, "
    + ", ".join(f"{strict_sql(c, p)} AS aqi_{p}" for p, c in STRICT_COLUMNS.items())
    + " FROM readings",
)
def f1(spark, sf):
    r = readings(spark, sf)
    return r.select(*KEY, *[A.aqi_strict(F.col(c), p).alias(f"aqi_{p}") for p, c in STRICT_COLUMNS.items()])


@query(
    "f2_aqi_clamped",
    f"WITH {READINGS}, {BP} SELECT station, seq, {clamped_sql('pm2_5', 'pm2_5')} AS aqi_pm2_5, "
    f"{clamped_sql('pm10', 'pm10')} AS aqi_pm10, {clamped_sql('coalesce(pm2_5, 0)', 'pm2_5')} AS served_pm2_5 "
    "FROM readings",
)
def f2(spark, sf):
    pm25, pm10 = F.col("pm2_5"), F.col("pm10")
    return readings(spark, sf).select(
        *KEY,
        A.aqi_clamped(pm25, "pm2_5").alias("aqi_pm2_5"),
        A.aqi_clamped(pm10, "pm10").alias("aqi_pm10"),
        A.aqi_clamped(pm25, "pm2_5", nonfinite_as_zero=True).alias("served_pm2_5"),
    )


# pollutant -> column, and the factor applied before the lookup
ANALYSIS = {
    "pm2_5": ("pm2_5", ""),
    "pm10": ("pm10", ""),
    "o3_8h": ("ozone", " * 0.5::DOUBLE"),
    "co": ("carbon_monoxide", " * 0.000873::DOUBLE"),
    "no2": ("nitrogen_dioxide", ""),
    "so2": ("sulphur_dioxide", ""),
}


def analysis_sql(p: str) -> str:
    c, factor = ANALYSIS[p]
    return f"coalesce({strict_sql(f'({c}{factor})', p, 'bpm')}, 0)"


@query(
    "f3_aqi_analysis",
    f"WITH {READINGS}, {BPM} SELECT station, seq, "
    + ", ".join(f"{analysis_sql(p)} AS aqi_{p}" for p in ANALYSIS)
    + " FROM readings",
)
def f3(spark, sf):
    return readings(spark, sf).select(
        *KEY, *[A.aqi_analysis(F.col(c), p).alias(f"aqi_{p}") for p, (c, _) in ANALYSIS.items()]
    )


AQI_SQL = (
    f"aqis AS (SELECT *, {US_AQI_SQL} AS us_aqi FROM (SELECT *, {strict_sql('pm2_5', 'pm2_5')} AS a25, "
    f"{strict_sql('pm10', 'pm10')} AS a10 FROM readings))"
)


@query(
    "f4_us_aqi",
    f"WITH {READINGS}, {BP}, {AQI_SQL} SELECT station, seq, a25 AS pm2_5_aqi, a10 AS pm10_aqi, us_aqi FROM aqis",
)
def f4(spark, sf):
    return A.with_aqi(readings(spark, sf)).select(*KEY, "pm2_5_aqi", "pm10_aqi", "us_aqi")


def individual(df):
    """One analysis index column per pollutant."""
    return df.withColumns(
        {f"{p}_individual_aqi": A.aqi_analysis(F.col(c), p) for p, (c, _) in ANALYSIS.items()}
    )


_FIRST_MAX = " ".join(f"WHEN a_{p} = m THEN '{p}'" for p in ANALYSIS)
INDIVIDUAL_SQL = (
    "indiv AS (SELECT *, CASE " + _FIRST_MAX + " END AS controlling FROM (SELECT *, greatest("
    + ", ".join(f"a_{p}" for p in ANALYSIS) + ") AS m FROM (SELECT *, "
    + ", ".join(f"{analysis_sql(p)} AS a_{p}" for p in ANALYSIS) + " FROM readings)))"
)


@query(
    "f5_controlling_pollutant",
    f"WITH {READINGS}, {BPM}, {INDIVIDUAL_SQL} SELECT station, seq, m AS max_aqi, controlling FROM indiv",
)
def f5(spark, sf):
    cols = [f"{p}_individual_aqi" for p in ANALYSIS]
    d = individual(readings(spark, sf))
    return d.select(
        *KEY, F.greatest(*cols).alias("max_aqi"), A.controlling_pollutant(cols).alias("controlling")
    )


@query(
    "f6_aqi_category",
    f"WITH {READINGS}, {BP}, {AQI_SQL} SELECT station, seq, us_aqi, {category_sql('us_aqi')} AS category, "
    f"{category_sql('us_aqi', 3)} AS color FROM aqis",
)
def f6(spark, sf):
    a = F.col("us_aqi")
    return A.with_aqi(readings(spark, sf)).select(
        *KEY, "us_aqi", A.aqi_category(a).alias("category"), A.aqi_colour(a).alias("color")
    )


def cyclic_sql(t: str = "time", mode: str = "observed") -> str:
    day = (f"day({t})", 31) if mode == "observed" else (f"dayofyear({t})", 365)
    parts = {"hour": (f"hour({t})", 24), "day": day, "month": (f"month({t})", 12),
             "day_of_week": (f"(isodow({t}) - 1)", 7)}
    return ", ".join(
        f"{fn}(2 * pi() * {e} / {n}::DOUBLE) AS {name}_{fn}" for name, (e, n) in parts.items() for fn in ("sin", "cos")
    )


@query("f7_cyclic_time", f"WITH {READINGS} SELECT station, seq, {cyclic_sql()} FROM readings",
       dbl=" ".join(CYCLIC_COLUMNS))
def f7(spark, sf):
    return X.cyclic_time(readings(spark, sf)).select(*KEY, *CYCLIC_COLUMNS)


@query("f8_cyclic_forecast", f"WITH {READINGS} SELECT station, seq, {cyclic_sql(mode='forecast')} FROM readings",
       dbl=" ".join(CYCLIC_COLUMNS))
def f8(spark, sf):
    return X.cyclic_time(readings(spark, sf), mode="forecast").select(*KEY, *CYCLIC_COLUMNS)


TIME_FLAGS_SQL = {
    "is_spring": "month(time) IN (3, 4, 5)",
    "is_summer": "month(time) IN (6, 7, 8)",
    "is_autumn": "month(time) IN (9, 10, 11)",
    "is_winter": "month(time) IN (12, 1, 2)",
    "is_night": "(hour(time) >= 22 OR hour(time) <= 6)",
    "is_morning_rush": "hour(time) IN (7, 8, 9)",
    "is_evening_rush": "hour(time) IN (17, 18, 19)",
}


def flags_sql(conds: dict[str, str]) -> str:
    return ", ".join(f"CAST(coalesce({c}, false) AS BIGINT) AS {n}" for n, c in conds.items())


@query("f9_time_flags", f"WITH {READINGS} SELECT station, seq, {flags_sql(TIME_FLAGS_SQL)} FROM readings")
def f9(spark, sf):
    return X.time_flags(readings(spark, sf)).select(*KEY, *TIME_FLAGS_SQL)


THRESHOLD_SQL = {n: f"{c} {op} {v}" for n, (c, op, v) in THRESHOLDS.items()}


@query("f10_threshold_flags", f"WITH {READINGS} SELECT station, seq, {flags_sql(THRESHOLD_SQL)} FROM readings")
def f10(spark, sf):
    return X.threshold_flags(readings(spark, sf)).select(*KEY, *THRESHOLDS)


@query(
    "f11_powers",
    f"WITH {READINGS} SELECT station, seq, " + ", ".join(f"pow({c}, {e}) AS {n}" for n, (c, e) in POWERS.items())
    + " FROM readings",
    dbl=" ".join(POWERS),
)
def f11(spark, sf):
    return X.powers(readings(spark, sf)).select(*KEY, *POWERS)


WIND_SQL = (
    "round_even(sin(radians(wind_direction)), 10) AS wind_direction_sin, "
    "round_even(cos(radians(wind_direction)), 10) AS wind_direction_cos"
)
PAIRS = {**BASE_INTERACTIONS, **EXTRA_INTERACTIONS}
PM_WEATHER = X.pm_weather_pairs(["pm2_5", "pm10"], ["temperature", "humidity", "pressure", "wind_speed"])


@query(
    "f12_interactions",
    f"WITH {READINGS} SELECT station, seq, "
    + ", ".join(f"{a} * {b} AS {n}" for n, (a, b) in {**PAIRS, **PM_WEATHER}.items())
    + f" FROM (SELECT *, {WIND_SQL} FROM readings)",
    dbl=" ".join({**PAIRS, **PM_WEATHER}),
)
def f12(spark, sf):
    d = X.interactions(X.wind_vector(readings(spark, sf)))
    return X.interactions(d, PM_WEATHER).select(*KEY, *{**PAIRS, **PM_WEATHER})


@query(
    "f13_wind_vector",
    f"WITH {READINGS} SELECT station, seq, {WIND_SQL} FROM readings",
    dbl="wind_direction_sin wind_direction_cos",
)
def f13(spark, sf):
    return X.wind_vector(readings(spark, sf)).select(*KEY, "wind_direction_sin", "wind_direction_cos")


WIND_FLAGS_SQL = {
    "is_wind_from_high_pm": "wind_direction_sin > 0.5 OR (wind_direction_sin > 0.3 AND wind_direction_cos > 0.3)",
    "is_wind_from_low_pm": "wind_direction_sin < -0.5 OR wind_direction_cos < -0.5",
}


@query(
    "f14_wind_source_flags",
    f"WITH {READINGS} SELECT station, seq, {flags_sql(WIND_FLAGS_SQL)} FROM (SELECT *, {WIND_SQL} FROM readings)",
)
def f14(spark, sf):
    return X.wind_source_flags(X.wind_vector(readings(spark, sf))).select(*KEY, *WIND_FLAGS_SQL)


CARDINAL_SQL = (
    "coalesce(["
    + ", ".join(f"'{c}'" for c in COMPASS)
    + "][CAST(floor((wind_direction + 11.25) / 22.5) AS INTEGER) % 16 + 1], 'Unknown')"
)


@query("f15_cardinal", f"WITH {READINGS} SELECT station, seq, {CARDINAL_SQL} AS wind_cardinal FROM readings")
def f15(spark, sf):
    return readings(spark, sf).select(*KEY, X.cardinal(F.col("wind_direction")).alias("wind_cardinal"))


@query(
    "f16_epoch_to_ts",
    f"WITH {READINGS} SELECT station, seq, make_timestamp(CAST(floor(epoch(time)) AS BIGINT) * 1000000) AS second "
    "FROM readings",
)
def f16(spark, sf):
    return readings(spark, sf).select(*KEY, X.epoch_to_ts(F.unix_seconds("time")).alias("second"))


@query(
    "f17_time_key",
    f"WITH {READINGS} SELECT station, seq, strftime(date_trunc('hour', time), '%Y-%m-%d %H:%M:%S') AS time_str "
    "FROM readings",
)
def f17(spark, sf):
    return readings(spark, sf).select(*KEY, X.time_key().alias("time_str"))


@query(
    "f18_hour_keys",
    f"""WITH {READINGS}, a AS (SELECT station, date_trunc('hour', max(time)) AS h FROM readings GROUP BY 1)
SELECT station, dir, h + to_hours(i) AS key_time, strftime(h + to_hours(i), '%Y-%m-%d %H:%M:%S') AS time_str
FROM (SELECT station, h, 'forward' AS dir, unnest(range(1, 73)) AS i FROM a
      UNION ALL SELECT station, h, 'backward', unnest(range(-71, 1)) FROM a)""",
)
def f18(spark, sf):
    last = readings(spark, sf).groupBy("station").agg(F.max("time").alias("anchor"))
    both = [
        X.hour_keys(last, "anchor", 72, fwd).withColumn("dir", F.lit(name))
        for fwd, name in ((True, "forward"), (False, "backward"))
    ]
    return both[0].unionByName(both[1]).select("station", "dir", "key_time", "time_str")


@query("f19_log_transform", f"WITH {READINGS} SELECT station, seq, ln(1 + pm2_5) AS pm2_5_log FROM readings",
       dbl="pm2_5_log")
def f19(spark, sf):
    return readings(spark, sf).select(*KEY, X.log_transform(F.col("pm2_5")).alias("pm2_5_log"))


@query(
    "f20_abs_deviation",
    f"WITH {READINGS}, {BP}, {AQI_SQL} SELECT station, seq, CASE WHEN seq % 7 <> 0 THEN "
    "abs(us_aqi - CAST(a25 + hour(time) % 5 AS INTEGER)) END AS abs_deviation FROM aqis",
)
def f20(spark, sf):
    d = A.with_aqi(readings(spark, sf))
    monitor = F.when(F.col("seq") % 7 != 0, F.col("pm2_5_aqi") + F.hour("time") % 5)
    return d.select(*KEY, A.abs_deviation(F.col("us_aqi"), monitor).alias("abs_deviation"))


@query(
    "f21_positional_encoding",
    f"""WITH {READINGS} SELECT station, h, sin(2 * pi() * h / 72::DOUBLE) AS pos_sin, cos(2 * pi() * h / 72::DOUBLE) AS pos_cos
FROM (SELECT station, unnest(CAST(range(1, 73) AS INTEGER[])) AS h FROM readings GROUP BY station)""",
    dbl="pos_sin pos_cos",
)
def f21(spark, sf):
    return X.positional_encoding(readings(spark, sf).select("station").distinct(), 72)


_TEMPLATES = ["temperature_scaled_target_{h}h", "hour_sin_target_hh", "nh3_scaled_target_24h", "pm2_5"]
_TEMPLATE_BASES = ["temperature_scaled", "hour_sin", "nh3_scaled", "pm2_5"]


@query(
    "f23_local_label",
    f"WITH {READINGS} SELECT station, seq, strftime(time + INTERVAL 5 HOUR, '%b %d, %H:%M') AS local_time FROM readings",
)
def f23(spark, sf):
    return readings(spark, sf).select(*KEY, X.local_label(F.col("time"), "Asia/Karachi").alias("local_time"))


@query(
    "f24_labels",
    f"""WITH {READINGS}, c AS (SELECT station, hour(time) AS hour, corr(pm2_5, pm10) AS r FROM readings GROUP BY ALL)
SELECT station, hour, CASE WHEN abs(r) > 0.5 THEN 'STRONG' WHEN abs(r) > 0.3 THEN 'MODERATE' WHEN abs(r) > 0.1 THEN 'WEAK'
 WHEN r IS NOT NULL THEN 'NEGLIGIBLE' END AS strength,
CASE WHEN hour * 3 < 24 THEN concat(hour * 3, 'h') WHEN hour * 3 % 24 = 0 THEN concat(hour * 3 // 24, 'd')
 ELSE concat(hour * 3 // 24, 'd', hour * 3 % 24, 'h') END AS horizon_text
FROM (SELECT station, CAST(hour AS INTEGER) AS hour, r FROM c)""",
)
def f24(spark, sf):
    c = readings(spark, sf).groupBy("station", F.hour("time").alias("hour")).agg(F.corr("pm2_5", "pm10").alias("r"))
    return c.select(
        "station", "hour", X.strength_label(F.col("r")).alias("strength"),
        X.horizon_label(F.col("hour") * 3).alias("horizon_text"),
    )


@query(
    "f25_cardinal_angle",
    f"""WITH {READINGS}, c AS (SELECT station, seq, {CARDINAL_SQL} AS wind_cardinal FROM readings)
SELECT station, seq, wind_cardinal, radians(coalesce(deg, 0)) AS angle FROM c LEFT JOIN
(VALUES {", ".join(f"('{n}', {22.5 * i}::DOUBLE)" for i, n in enumerate(COMPASS))}) t(wind_cardinal, deg) USING (wind_cardinal)""",
    dbl="angle",
)
def f25(spark, sf):
    d = readings(spark, sf).select(*KEY, X.cardinal(F.col("wind_direction")).alias("wind_cardinal"))
    return d.withColumn("angle", X.cardinal_angle(F.col("wind_cardinal")))


@query(
    "f26_label_encode",
    f"""WITH {READINGS}, r AS (SELECT station, seq, time, {CARDINAL_SQL} AS wind_cardinal FROM readings),
codes AS (SELECT wind_cardinal, CAST(row_number() OVER (ORDER BY min(time)) - 1 AS INTEGER) AS code FROM r GROUP BY 1)
SELECT station, seq, wind_cardinal, code FROM r JOIN codes USING (wind_cardinal)""",
)
def f26(spark, sf):
    d = readings(spark, sf).select(*KEY, "time", X.cardinal(F.col("wind_direction")).alias("wind_cardinal"))
    return X.label_encode(d, "wind_cardinal", "code").drop("time")


@query(
    "u1_sql_functions",
    f"""WITH {READINGS}, {BP}, h AS (SELECT station, date_trunc('hour', time) AS hour, avg(pm2_5) AS pm2_5, avg(pm10) AS pm10 FROM readings
WHERE time >= TIMESTAMP '2024-01-03 00:00:00' AND time < TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1, 2),
x AS (SELECT station, hour, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END AS us
FROM (SELECT *, {strict_sql('pm2_5', 'pm2_5')} AS a, {strict_sql('pm10', 'pm10')} AS b FROM h))
SELECT station, strftime(hour, '%Y-%m-%d') AS day, count(*) AS hours, CAST(max(us) AS INTEGER) AS worst, {category_sql('max(us)')} AS category
FROM x WHERE us >= 60 GROUP BY 1, 2""",
)
def u1(spark, sf):
    """Nothing but SQL from here on: a table function over a view, and a scalar one on its result."""
    from breezeframe.functions.aqi import register_sql_tables
    from breezeframe.sources.tables import register_view

    view = register_name(spark)
    register_view(readings(spark, sf), view)
    register_sql_tables(spark, view)
    return spark.sql(f"""SELECT station, CAST(day AS STRING) AS day, hours, worst, aqi_category(worst) AS category
FROM {view}_exceedances(60, TIMESTAMP '2024-01-03 00:00:00', TIMESTAMP '2024-01-20 12:00:00')""")


def register_name(spark) -> str:
    """A view name no other caller has."""
    from breezeframe.session import scratch_path

    return scratch_path(spark, "readings").rsplit("/", 1)[1].replace("-", "_")
