"""Scaling, splits, evaluation, models, end-to-end plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeframe import fixtures as X
from breezeframe.catalog.registry import query
from breezeframe.catalog.scalars import (
    AQI_SQL,
    BP,
    PAIRS,
    THRESHOLD_SQL,
    TIME_FLAGS_SQL,
    WIND_FLAGS_SQL,
    WIND_SQL,
    category_sql,
    clamped_sql,
    cyclic_sql,
    flags_sql,
)
from breezeframe.catalog.shaping import iqr_sql
from breezeframe.catalog.windows import lag_sql
from breezeframe.fixtures import LAST_HOURS, PANEL, PREDICTIONS, READINGS, panel_hourly, readings
from breezeframe.operators import evaluate as E
from breezeframe.operators import frames as R
from breezeframe.operators import models as M
from breezeframe.operators import scaling as S
from breezeframe.operators import windows as W
from breezeframe.operators.aggregates import corr_pairs
from breezeframe.plans import features as PF
from breezeframe.plans import forecasts as PC
from breezeframe.plans import training as E4
from breezeframe.schema import (
    BASE_INTERACTIONS,
    CLEAN_FEATURES,
    CYCLIC_COLUMNS,
    EXTRA_INTERACTIONS,
    IQR_COLUMNS,
    MEASURES,
    SCALE_GROUPS,
)

_N = "nn AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY time) AS i, count(*) OVER (PARTITION BY station) AS n FROM panel)"
_TRAIN = "tr AS (SELECT *, i <= floor(0.8::DOUBLE * n) AS is_train FROM nn)"
_SC = [c for cs in SCALE_GROUPS.values() for c in cs]


@query(
    "m1_fit_scaler",
    f"WITH {PANEL}, {_N}, {_TRAIN} "
    + " UNION ALL ".join(
        f"SELECT station, '{g}' AS grp, '{c}' AS feature, avg({c}) AS mean, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS scale FROM tr WHERE is_train GROUP BY station"
        for g, cs in SCALE_GROUPS.items() for c in cs
    ),
    dbl="mean scale",
)
def m1(spark, sf):
    p = R.chrono_split(panel_hourly(spark, sf), 0.2)
    return S.fit_scaler(p, SCALE_GROUPS, "is_train")


@query(
    "m2_apply_scaler",
    f"WITH {PANEL} SELECT station, time, "
    + ", ".join(f"({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w AS {c}_scaled, {c} AS {c}_back" for c in ("pm2_5", "temperature"))
    + " FROM panel WINDOW w AS (PARTITION BY station)",
    dbl="pm2_5_scaled temperature_scaled pm2_5_back temperature_back",
)
def m2(spark, sf):
    p = panel_hourly(spark, sf).select("station", "time", "pm2_5", "temperature", "humidity")
    params = S.fit_scaler(p, {"pm": ["pm2_5"], "weather": ["temperature", "humidity"]})
    cols = ["pm2_5", "temperature"]
    scaled = S.apply_scaler(p, params, cols)
    back = scaled.withColumns({c: F.col(f"{c}_scaled") for c in cols})
    out = S.inverse_scaler(back, params, cols, suffix="_back")
    return out.select("station", "time", *[f"{c}{s}" for c in cols for s in ("_scaled", "_back")])


@query(
    "m3_chrono_split",
    f"WITH {PANEL}, {_N} SELECT station, time, i <= floor(0.8::DOUBLE * n) AS is_train, i <= n - ceil(0.2::DOUBLE * n) AS is_train_ceil FROM nn",
)
def m3(spark, sf):
    p = panel_hourly(spark, sf).select("station", "time", "seq")
    a = R.chrono_split(p, 0.2).drop("seq")
    b = R.chrono_split(p, 0.2, "ceil").select("station", "time", F.col("is_train").alias("is_train_ceil"))
    return a.join(b, ["station", "time"])


_FOLDS = ", ".join(f"({i + 1}, {f!r}::DOUBLE)" for i, f in enumerate(R.fold_fractions(4)))


@query(
    "m4_walk_forward",
    f"""WITH {PANEL}, {_N}, f AS (SELECT n.*, fold, CAST(greatest(1, least(n - 1, round_even(frac * n, 0))) AS BIGINT) AS fold_end
FROM nn n, (VALUES {_FOLDS}) t(fold, frac)) SELECT station, time, pm2_5, fold, fold_end FROM f WHERE i <= fold_end""",
)
def m4(spark, sf):
    return R.walk_forward(panel_hourly(spark, sf).select("station", "time", "seq", "pm2_5")).drop("seq")


@query(
    "m5_delta_targets",
    f"""WITH {PANEL}, {_N}, {_TRAIN}, p AS (SELECT station, avg(pm2_5) AS m, stddev_pop(pm2_5) AS s FROM tr WHERE is_train GROUP BY 1)
SELECT a.station, a.time, CAST(h AS INTEGER) AS h, a.is_train, b.pm2_5 AS y, (b.pm2_5 - m) / s AS y_scaled, (a.pm2_5 - m) / s AS base_scaled,
 (b.pm2_5 - m) / s - (a.pm2_5 - m) / s AS y_delta, CASE WHEN a.pm2_5 IS NOT NULL THEN b.pm2_5 END AS y_back
FROM (SELECT *, unnest([1, 24]) AS h FROM tr) a JOIN p USING (station) LEFT JOIN tr b ON b.station = a.station AND b.time = a.time + to_hours(h)""",
    dbl="y_scaled base_scaled y_delta y_back",
)
def m5(spark, sf):
    p = panel_hourly(spark, sf).select("station", "time", "seq", "pm2_5", "pm10")
    f = PC.training_frame(p, [1, 24]).filter("target = 'pm2_5'")
    flagged = R.chrono_split(p, 0.2)
    params = S.fit_scaler(flagged, {"pm": ["pm2_5"]}, "is_train").select("station", "mean", "scale")
    back = R.undo_delta(f, "y_delta", "base_scaled", "y_back").join(params, "station")
    return back.withColumn("y_back", F.col("y_back") * F.col("scale") + F.col("mean")).drop("target", "mean", "scale")


_MET = """sqrt(avg(pow(y_true - y_pred, 2))) AS rmse, avg(abs(y_true - y_pred)) AS mae,
1 - sum(pow(y_true - y_pred, 2)) / (var_pop(y_true) * count(*)) AS r2, count(*) AS n"""


@query("m6_horizon_metrics", f"WITH {PREDICTIONS} SELECT station, h, target, {_MET} FROM predictions GROUP BY ALL", dbl="rmse mae r2")
def m6(spark, sf):
    return E.horizon_metrics(X.predictions(spark, sf))


_WEIGHT = "CASE WHEN h <= 3 THEN 5 WHEN h <= 24 THEN 3 ELSE 1 END"


@query(
    "m7_weighted_loss",
    f"""WITH {PREDICTIONS} SELECT station, avg(l * {_WEIGHT}) AS loss FROM (SELECT station, base_time, h,
avg(pow(y_true - y_pred, 2)) + 0.2 * avg(abs(y_true - y_pred)) AS l FROM predictions GROUP BY ALL) GROUP BY station""",
    dbl="loss",
)
def m7(spark, sf):
    return E.weighted_loss(X.predictions(spark, sf))


@query(
    "m7b_band_errors",
    f"WITH {PREDICTIONS} SELECT station, target, avg(pow(y_true - y_pred, 2)) AS mse FROM predictions WHERE h BETWEEN 6 AND 24 GROUP BY ALL",
    dbl="mse",
)
def m7b(spark, sf):
    return E.band_errors(X.predictions(spark, sf))


@query(
    "m8_error_listing",
    f"""WITH {PREDICTIONS} SELECT station, base_time, h, target, y_true, y_pred, y_pred - y_true AS diff,
CASE WHEN y_true <> 0 THEN abs(y_pred - y_true) / y_true * 100 ELSE 0 END AS percent_error FROM (SELECT *,
row_number() OVER (PARTITION BY station, h, target ORDER BY base_time) AS rn FROM predictions) WHERE rn <= 10""",
    dbl="diff percent_error",
)
def m8(spark, sf):
    return E.error_listing(X.predictions(spark, sf), 10)


_DAY = "day(base_time) <= 20"


@query(
    "m9_overfit_gap",
    f"""WITH {PREDICTIONS}, a AS (SELECT station, h, target, {_MET} FROM predictions WHERE {_DAY} GROUP BY ALL),
b AS (SELECT station, h, target, {_MET} FROM predictions WHERE NOT {_DAY} GROUP BY ALL)
SELECT station, h, target, a.r2 AS train_r2, b.r2 AS test_r2, a.r2 - b.r2 AS gap, a.r2 - b.r2 > 0.1 AS overfit FROM a JOIN b USING (station, h, target)""",
    dbl="train_r2 test_r2 gap",
)
def m9(spark, sf):
    p = X.predictions(spark, sf)
    early = F.dayofmonth("base_time") <= 20
    return E.overfit_gap(E.horizon_metrics(p.filter(early)), E.horizon_metrics(p.filter(~early)))


_IDX = "CASE WHEN target = 'pm10' THEN {b} ELSE {a} END"


def _cat(c: str) -> str:
    return category_sql(_IDX.format(a=clamped_sql(c, "pm2_5"), b=clamped_sql(c, "pm10")))


@query(
    "m10_category_accuracy",
    f"""WITH {PREDICTIONS}, {BP} SELECT station, target, CAST((h - 1) // 24 + 1 AS INTEGER) AS day,
avg((ct = cp)::INT) AS accuracy, count(*) AS n FROM (SELECT *, {category_sql('it')} AS ct, {category_sql('ip')} AS cp FROM (SELECT *,
{_IDX.format(a=clamped_sql('y_true', 'pm2_5'), b=clamped_sql('y_true', 'pm10'))} AS it,
{_IDX.format(a=clamped_sql('y_pred', 'pm2_5'), b=clamped_sql('y_pred', 'pm10'))} AS ip FROM predictions)) GROUP BY ALL""",
    dbl="accuracy",
)
def m10(spark, sf):
    return E.category_accuracy(X.predictions(spark, sf))


@query(
    "p14b_merge_metrics",
    f"""WITH {PREDICTIONS} SELECT station, h, target, CASE WHEN h < 12 THEN e ELSE e * 2 END AS rmse
FROM (SELECT station, h, target, sqrt(avg(pow(y_true - y_pred, 2))) AS e FROM predictions GROUP BY station, h, target)""",
    dbl="rmse",
)
def p14b(spark, sf):
    m = E.horizon_metrics(X.predictions(spark, sf)).select("station", "h", "target", "rmse")
    return E.merge_metrics(m, m.withColumn("rmse", F.col("rmse") * 2), 12, prefer="mid")


@query(
    "m4b_fold_average",
    f"""WITH {PREDICTIONS}, f AS (SELECT p.*, fold FROM predictions p, (VALUES (1), (2), (3)) t(fold) WHERE day(base_time) <= 10 * fold),
m AS (SELECT station, h, target, fold, {_MET} FROM f GROUP BY ALL) SELECT station, h, target, avg(rmse) AS rmse, avg(mae) AS mae, avg(r2) AS r2 FROM m GROUP BY ALL""",
    dbl="rmse mae r2",
)
def m4b(spark, sf):
    inside = F.filter(F.sequence(F.lit(1), F.lit(3)), lambda f: F.dayofmonth("base_time") <= f * 10)
    p = X.predictions(spark, sf).withColumn("fold", F.explode(inside))
    return E.fold_average(E.horizon_metrics(p, ["station", "h", "target", "fold"]))


# --- models --------------------------------------------------------------------------

_FEATURES = ["pm2_5", "pm10", "temperature", "humidity", "wind_speed", "ozone"]


def _supervised(spark, sf, horizons):
    p = panel_hourly(spark, sf)
    return R.targets(p.select("station", "time", "seq", *_FEATURES), horizons=horizons)


def _fitted(spark, sf, kind="forest"):
    sup = _supervised(spark, sf, [1, 24])
    extra = {"numTrees": 8} if kind == "forest" else {"maxIter": 5}
    return sup, M.fit_trees(sup, _FEATURES, [1, 24], kind=kind, maxDepth=4, seed=7, **extra)


@query("m11_fit_trees")
def m11(spark, sf):
    sup, models = _fitted(spark, sf)
    return M.predict_trees(models, sup, _FEATURES, ["station", "time"])


_ALL_KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in _FEATURES)
_FUTURE = """f AS (SELECT station, time, ({known}) AS whole, unnest([1, 1, 24, 24]) AS h, unnest(['pm2_5', 'pm10', 'pm2_5', 'pm10']) AS target,
unnest([lead(pm2_5, 1) OVER w, lead(pm10, 1) OVER w, lead(pm2_5, 24) OVER w, lead(pm10, 24) OVER w]) AS y
FROM panel WINDOW w AS (PARTITION BY station ORDER BY time, seq))""".format(known=_ALL_KNOWN)


@query(
    "m11b_predicted_rows",
    f"""WITH {PANEL}, {_FUTURE} SELECT station, CAST(h AS INTEGER) AS h, target, count(*) AS rows, count(y) AS known, count(*) FILTER (whole) AS predicted,
count(*) FILTER (NOT whole) AS left_out, true AS inside_training_range FROM f GROUP BY station, h, target""",
)
def m11b(spark, sf):
    """Every input row gets a prediction or a counted null, and trees stay within what they saw."""
    sup, models = _fitted(spark, sf)
    seen = M.predict_trees(models, sup, _FEATURES, ["station", "time"])
    ends = [F.min("y_true").alias("lo"), F.max("y_true").alias("hi")]
    trained = seen.where("y_pred IS NOT NULL AND y_true IS NOT NULL").groupBy("h", "target").agg(*ends)
    inside = F.coalesce(F.bool_and(F.col("y_pred").between(F.col("lo") - 1e-9, F.col("hi") + 1e-9)), F.lit(True))
    found = seen.join(trained, ["h", "target"]).groupBy("station", "h", "target").agg(
        F.count(F.lit(1)).alias("rows"), F.count("y_true").alias("known"), F.count("y_pred").alias("predicted"),
        inside.alias("inside_training_range"),
    )
    lacking = M.left_out(sup, _FEATURES).select("station", F.col("incomplete").alias("left_out"))
    return found.join(lacking, "station")


@query("m12_rollout")
def m12(spark, sf):
    p = panel_hourly(spark, sf)
    steps = 4
    shifts = {f"{t}_lag_{k}h": (t, k - 1) for t in ("pm2_5", "pm10") for k in (1, 2, 3)}
    shifts |= {f"temperature_target_{h}h": ("temperature", -h) for h in range(1, steps + 1)}
    shifts |= {f"{t}_target_1h": (t, -1) for t in ("pm2_5", "pm10")}
    filled = W.fill_gaps(p.select("station", "time", "seq", "pm2_5", "pm10", "temperature"))
    frame = W.shift(filled, shifts)
    feats = [f"{t}_lag_{k}h" for t in ("pm2_5", "pm10") for k in (1, 2, 3)] + ["temperature_target_1h"]
    fitted = M.fit_trees(frame, feats, [1], maxDepth=4, numTrees=5, seed=7)
    whole = frame.na.drop(subset=[*feats, *[f"temperature_target_{h}h" for h in range(1, steps + 1)]])
    return M.rollout({t: m for (t, _), m in fitted.items()}, whole, feats, steps, ["station", "time"], ["temperature"], checkpoint_every=2)


@query(
    "m12b_first_step",
    f"""WITH {PANEL}, k AS (SELECT station, {_ALL_KNOWN} AS whole FROM panel)
SELECT station, t.target, count(*) AS rows, 0::BIGINT AS different FROM k, (VALUES ('pm2_5'), ('pm10')) t(target) WHERE whole GROUP BY station, t.target""",
)
def m12b(spark, sf):
    """The first step of a rollout is the one-step model's prediction."""
    p = panel_hourly(spark, sf)
    known = p.where(M.complete(_FEATURES)).select("station", "time", "seq", *_FEATURES)
    lags = {f"{t}_lag_{k}h": (t, k - 1) for t in ("pm2_5", "pm10") for k in (1, 2, 3)}
    frame = W.shift(known, {**lags, "temperature_target_1h": ("temperature", -1), **{f"{t}_target_1h": (t, -1) for t in ("pm2_5", "pm10")}})
    feats = [*lags, "temperature_target_1h"]
    frame = frame.fillna(0.0, feats)
    fitted = M.fit_trees(frame, feats, [1], maxDepth=4, numTrees=5, seed=7)
    rolled = M.rollout({t: m for (t, _), m in fitted.items()}, frame, feats, 1, ["station", "time"], ["temperature"])
    once = M.predict_trees(fitted, frame, feats, ["station", "time"]).select("station", "time", "h", "target", F.col("y_pred").alias("one_step"))
    both = rolled.join(once, ["station", "time", "h", "target"])
    return both.groupBy("station", "target").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(~F.col("y_pred").eqNullSafe(F.col("one_step")), 1)).alias("different")
    )


@query("m13_importance")
def m13(spark, sf):
    _, models = _fitted(spark, sf, "boosted")
    return M.importance(models, _FEATURES, spark)


@query(
    "m13b_importance_sums",
    f"""WITH {PANEL} SELECT t.target, CAST(hs.h AS INTEGER) AS h, 1.0::DOUBLE AS total, 6::BIGINT AS features, true AS none_negative
FROM (SELECT DISTINCT 1 AS one FROM panel), (VALUES ('pm2_5'), ('pm10')) t(target), (VALUES (1), (24)) hs(h)""",
    dbl="total",
)
def m13b(spark, sf):
    _, models = _fitted(spark, sf, "boosted")
    return M.importance(models, _FEATURES, spark).groupBy("target", "h").agg(
        F.sum("importance").alias("total"), F.count_distinct("feature").alias("features"),
        F.bool_and(F.col("importance") >= 0).alias("none_negative"),
    )


_IMP = ["temperature", "humidity", "pressure", "ozone", "nh3"]


@query(
    "o4_top_importance",
    f"""WITH {PANEL}, i AS ({" UNION ALL ".join(f"SELECT station, '{t}' AS target, '{x}' AS feature, abs(corr({x}, {t})) AS importance FROM panel GROUP BY station" for x in _IMP for t in ("pm2_5", "pm10"))}),
c AS (SELECT * FROM i UNION ALL SELECT station, 'combined', feature, avg(importance) FROM i GROUP BY station, feature)
SELECT station, target, feature, importance FROM (SELECT *, row_number() OVER (PARTITION BY station, target ORDER BY importance DESC, feature) AS rn FROM c)
WHERE rn <= CASE WHEN target = 'combined' THEN 2 ELSE 3 END""",
    dbl="importance",
)
def o4(spark, sf):
    c = corr_pairs(panel_hourly(spark, sf), [(x, t) for x in _IMP for t in ("pm2_5", "pm10")], names=("feature", "target"))
    imp = c.select("station", "target", "feature", F.abs("r").alias("importance"))
    return M.top_importance(imp, 3, ["station", "target"], combined=2)


_TPL = ["temperature_scaled_target_{h}h", "humidity_scaled_target_hh", "hour_sin_target_hh", "nh3_scaled_target_{h}h"]


@query(
    "m14_scoring_frame",
    f"""WITH {PANEL}, {LAST_HOURS}, pr AS (SELECT station, avg(temperature) AS mt, stddev_pop(temperature) AS st, avg(humidity) AS mh, stddev_pop(humidity) AS sh,
 avg(nh3) AS mn, stddev_pop(nh3) AS sn, avg(pm2_5) AS ma, stddev_pop(pm2_5) AS sa, avg(pm10) AS mb, stddev_pop(pm10) AS sb FROM panel GROUP BY station),
l AS (SELECT station, arg_max(pm2_5, time) AS a, arg_max(pm10, time) AS b FROM panel WHERE pm2_5 IS NOT NULL AND pm10 IS NOT NULL GROUP BY station)
SELECT f.station, step_hour, (temperature - mt) / st AS temperature_scaled, (humidity - mh) / sh AS humidity_scaled, sin(2 * pi() * hour(time) / 24.0) AS hour_sin,
(nh3 - mn) / sn AS nh3_scaled, sin(2 * pi() * step_hour / 72.0) AS pos_sin, cos(2 * pi() * step_hour / 72.0) AS pos_cos, (a - ma) / sa AS pm2_5_scaled_0, (b - mb) / sb AS pm10_scaled_0
FROM fc f JOIN pr USING (station) JOIN l USING (station)""",
    dbl="temperature_scaled humidity_scaled hour_sin nh3_scaled pos_sin pos_cos pm2_5_scaled_0 pm10_scaled_0",
)
def m14(spark, sf):
    p = panel_hourly(spark, sf)
    params = S.fit_scaler(p, SCALE_GROUPS)
    fc = PC.forecast_features(X.forecast_weather(spark, sf), X.forecast_pollution(spark, sf))
    known = p.filter("pm2_5 IS NOT NULL AND pm10 IS NOT NULL")
    last = known.groupBy("station").agg(F.max_by("pm2_5", "time").alias("pm2_5"), F.max_by("pm10", "time").alias("pm10"))
    return M.scoring_frame(PC.scaled_forecast(fc, params), S.apply_scaler(last, params, ["pm2_5", "pm10"]), _TPL, 72)


@query(
    "m15_forecast_report",
    f"""WITH {PANEL}, {LAST_HOURS}, {BP}, m AS (SELECT station, step_hour AS h, CASE WHEN step_hour <= 12 THEN pm2_5 ELSE pm2_5 * 2 END AS pm2_5,
CASE WHEN step_hour <= 12 THEN pm10 ELSE pm10 * 2 END AS pm10 FROM fc)
SELECT *, greatest(aqi_pm2_5, aqi_pm10) AS aqi FROM (SELECT *, {clamped_sql('pm2_5', 'pm2_5')} AS aqi_pm2_5, {clamped_sql('pm10', 'pm10')} AS aqi_pm10 FROM m)""",
)
def m15(spark, sf):
    fc = X._last_hours(panel_hourly(spark, sf)).select("station", F.col("step_hour").alias("h"), "pm2_5", "pm10")
    return M.forecast_report(fc, fc.withColumns({"pm2_5": F.col("pm2_5") * 2, "pm10": F.col("pm10") * 2}))


_CM = ["pm2_5", "pm10", "carbon_monoxide", "ozone", "sulphur_dioxide", "nh3", "wind_direction"]
_FILLED = "fl AS (SELECT station, seq, time, " + ", ".join(
    f"""coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY station ORDER BY time, seq ROWS UNBOUNDED PRECEDING),
first_value({c} IGNORE NULLS) OVER (PARTITION BY station ORDER BY time, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"""
    for c in _CM
) + " FROM readings)"
_NOTNULL = " AND ".join(f"{c} IS NOT NULL" for c in _CM)
_CLEAN = {
    "a": f"{_FILLED}, cl AS (SELECT * FROM fl WHERE {_NOTNULL} AND pm2_5 > 0 AND pm10 > 0)",
    "b": f"cl AS (SELECT station, seq, time, {', '.join(_CM)} FROM readings WHERE {_NOTNULL} AND pm2_5 > 0 AND pm10 > 0)",
    "c": f"{_FILLED}, cl AS (SELECT * FROM fl)",
}


def _register_clean(mode: str):
    ctes, last = iqr_sql("cl", IQR_COLUMNS)

    @query(
        f"m16{mode}_clean_series",
        f"WITH {READINGS}, {_CLEAN[mode]}, {ctes} SELECT station, seq, time, {', '.join(_CM)} FROM {last}",
    )
    def run(spark, sf):
        return PC.clean_series(readings(spark, sf).select("station", "seq", "time", *_CM), mode)


for _mode in "abc":
    _register_clean(_mode)


# --- end to end ----------------------------------------------------------------------


def clean_features_sql() -> str:
    """The whole hourly job as SQL: one join per lag, one frame per range statistic."""
    lag_specs = {s.name: s for s in [*W.target_lags(), *W.extra_lags()]}
    roll_specs = {s.name: s for s in [*W.target_rolling(), *W.extra_rolling()]}
    change_specs = {s.name: s for s in W.target_changes()}
    stats = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    ctes, joins, cols, hours = [], [], [], set()
    for i, c in enumerate(CLEAN_FEATURES):
        if c in lag_specs:
            s = lag_specs[c]
            ctes.append(f"l{i} AS ({lag_sql(s.column, s.hours, s.tolerance)})")
            joins.append(f"LEFT JOIN l{i} USING (station, seq)")
            cols.append(f"l{i}.v AS {c}")
        elif c in change_specs:
            s = change_specs[c]
            tol = W.Lag(c, s.column, s.hours).tolerance
            ctes.append(f"l{i} AS ({lag_sql(s.column, s.hours, tol)})")
            joins.append(f"LEFT JOIN l{i} USING (station, seq)")
            cols.append(f"CASE WHEN l{i}.v <> 0 THEN (r.{s.column} - l{i}.v) / l{i}.v END AS {c}")
        elif c in roll_specs:
            s = roll_specs[c]
            hours.add(s.hours)
            cols.append(f"r.{c}")
        elif c in EXTRA_INTERACTIONS:
            a, b = EXTRA_INTERACTIONS[c]
            cols.append(f"r.{a} * r.{b} AS {c}")
        elif c == "time_str":
            cols.append("strftime(date_trunc('hour', r.time), '%Y-%m-%d %H:%M:%S') AS time_str")
        elif c in ("us_aqi", *BASE_INTERACTIONS, *MEASURES):
            cols.append(f"f.{c}")
        else:
            cols.append(f"r.{c}")
    rolls = ", ".join(
        f"CASE WHEN count(*) OVER w{s.hours} >= 2 THEN {stats[s.stat]}({s.column}) OVER w{s.hours} END AS {n}"
        for n, s in roll_specs.items() if n in CLEAN_FEATURES
    )
    wins = ", ".join(
        f"w{h} AS (PARTITION BY station ORDER BY time RANGE BETWEEN INTERVAL {h} HOURS PRECEDING AND CURRENT ROW)" for h in sorted(hours)
    )
    products = ", ".join(f"{a} * {b} AS {n}" for n, (a, b) in BASE_INTERACTIONS.items())
    fills = ", ".join(
        f"""CAST(coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY station ORDER BY time, seq ROWS UNBOUNDED PRECEDING),
first_value({c} IGNORE NULLS) OVER (PARTITION BY station ORDER BY time, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS DOUBLE) AS {c}"""
        for c in [*MEASURES, "us_aqi", *BASE_INTERACTIONS]
    )
    body = f"""WITH {READINGS}, {BP}, {AQI_SQL},
w AS (SELECT *, {WIND_SQL}, {cyclic_sql()}, {flags_sql(THRESHOLD_SQL)}, {flags_sql(TIME_FLAGS_SQL)}, {products} FROM aqis),
rl AS (SELECT *, {flags_sql(WIND_FLAGS_SQL)}, {rolls} FROM w WINDOW {wins}),
fl AS (SELECT station, seq, {fills} FROM w), {", ".join(ctes)}
SELECT r.station, {", ".join(cols)} FROM rl r JOIN fl f USING (station, seq) {" ".join(joins)}"""
    return body


_EXACT = {"time", "time_str", "is_wind_from_high_pm", "is_wind_from_low_pm", "is_hot", "is_night", "is_morning_rush",
          "is_evening_rush", "is_high_pm2_5", "is_high_o3"}


@query("e1_clean_features", clean_features_sql(), dbl=" ".join(c for c in CLEAN_FEATURES if c not in _EXACT))
def e1(spark, sf):
    return PF.clean_features(readings(spark, sf))


@query(
    "e2_forecast_features",
    f"""WITH {PANEL}, {LAST_HOURS} SELECT station, step_hour, time AS target_time, temperature, humidity, pressure, wind_speed, {WIND_SQL},
{cyclic_sql(mode='forecast')}, carbon_monoxide, ozone, sulphur_dioxide, nh3, strftime(time, '%Y-%m-%d %H:%M:%S') AS time_str FROM fc""",
    dbl="wind_direction_sin wind_direction_cos " + " ".join(CYCLIC_COLUMNS),
)
def e2(spark, sf):
    return PC.forecast_features(X.forecast_weather(spark, sf), X.forecast_pollution(spark, sf))


@query(
    "e3_predict_report",
    f"""WITH {PANEL}, {LAST_HOURS}, {BP},
l AS (SELECT station, arg_max(pm2_5, time) AS a, arg_max(pm10, time) AS b FROM panel WHERE pm2_5 IS NOT NULL AND pm10 IS NOT NULL GROUP BY station),
p AS (SELECT station, avg(pm2_5) AS ma, stddev_pop(pm2_5) AS sa, avg(pm10) AS mb, stddev_pop(pm10) AS sb FROM panel GROUP BY station),
m AS (SELECT station, step_hour AS h, round(a + sa * step_hour / 100.0 + 3.7e-9, 6) AS pm2_5, round(b + sb * step_hour / 50.0 + 3.7e-9, 6) AS pm10 FROM fc JOIN l USING (station) JOIN p USING (station))
SELECT *, greatest(aqi_pm2_5, aqi_pm10) AS aqi FROM (SELECT *, {clamped_sql('pm2_5', 'pm2_5')} AS aqi_pm2_5, {clamped_sql('pm10', 'pm10')} AS aqi_pm10 FROM m)""",
)
def e3(spark, sf):
    p = panel_hourly(spark, sf)
    params = S.fit_scaler(p, {"pm": ["pm2_5", "pm10"]})
    known = p.filter("pm2_5 IS NOT NULL AND pm10 IS NOT NULL")
    last = known.groupBy("station").agg(F.max_by("pm2_5", "time").alias("pm2_5"), F.max_by("pm10", "time").alias("pm10"))
    scaled = S.apply_scaler(last, params, ["pm2_5", "pm10"]).select(
        "station", *[F.col(f"{c}_scaled").alias(f"{c}_scaled_0") for c in ("pm2_5", "pm10")]
    )
    fc = X._last_hours(p).select("station", F.col("step_hour").alias("h")).join(scaled, "station")
    # a stand-in model: the scaled change grows with the step
    delta = fc.withColumns({"pm2_5": F.col("h") / 100.0, "pm10": F.col("h") / 50.0})
    pred = PC.undo_predictions(delta, params).select(
        "station", "h", X.round6(F.col("pm2_5")).alias("pm2_5"), X.round6(F.col("pm10")).alias("pm10")
    )
    return M.forecast_report(pred, pred)


# --- training and evaluation ---------------------------------------------------------


@query("e4_train_evaluate")
def e4(spark, sf):
    p = panel_hourly(spark, sf)
    short = E4.train_and_evaluate(p, _FEATURES, [1, 6], maxDepth=4, numTrees=8, seed=7)[1]
    long = E4.train_and_evaluate(p, _FEATURES, [6, 24], maxDepth=4, numTrees=8, seed=7)[1]
    return E4.banded(short, long)


_WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in _FEATURES)


@query(
    "e4b_split_sizes",
    f"""WITH {PANEL}, w AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY time, seq) AS i, count(*) OVER (PARTITION BY station) AS m
FROM panel WHERE {_WHOLE}), t AS (SELECT station, i <= floor(0.8::DOUBLE * m) AS is_train, unnest([1, 24]) AS h,
unnest([lead(pm2_5, 1) OVER s, lead(pm2_5, 24) OVER s]) AS y FROM w WINDOW s AS (PARTITION BY station ORDER BY time, seq))
SELECT station, h, is_train, count(y) AS n, avg(y) AS mean FROM t GROUP BY ALL""",
    dbl="mean",
)
def e4b(spark, sf):
    rows = E4.supervised(panel_hourly(spark, sf), _FEATURES, [1, 24], ["pm2_5"])
    cells = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"pm2_5_target_{h}h").alias("y")) for h in (1, 24)]))
    long = rows.select("station", "is_train", cells.alias("c"))
    return long.groupBy("station", "c.h", "is_train").agg(F.count("c.y").alias("n"), F.avg("c.y").alias("mean"))


@query(
    "e4c_evaluated_rows",
    f"""WITH {PANEL}, w AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY time, seq) AS i, count(*) OVER (PARTITION BY station) AS m
FROM panel WHERE {_WHOLE}), t AS (SELECT station, i <= floor(0.8::DOUBLE * m) AS is_train, unnest([1, 1, 6, 6]) AS h, unnest(['pm2_5', 'pm10', 'pm2_5', 'pm10']) AS target,
unnest([lead(pm2_5, 1) OVER s, lead(pm10, 1) OVER s, lead(pm2_5, 6) OVER s, lead(pm10, 6) OVER s]) AS y FROM w WINDOW s AS (PARTITION BY station ORDER BY time, seq))
SELECT t.station, CAST(h AS INTEGER) AS h, target, count(y) FILTER (is_train) AS train_n, count(y) FILTER (NOT is_train) AS test_n,
any_value(o.n_left_out) AS n_left_out, true AS measured
FROM t JOIN (SELECT station, count(*) FILTER (NOT ({_WHOLE})) AS n_left_out FROM panel GROUP BY station) o USING (station) GROUP BY t.station, h, target""",
)
def e4c(spark, sf):
    """How many rows each figure of the evaluation rests on, and how many lacked a feature."""
    found = E4.train_and_evaluate(panel_hourly(spark, sf), _FEATURES, [1, 6], maxDepth=4, numTrees=8, seed=7)[1]
    measured = F.col("train_rmse").isNotNull() & F.col("test_rmse").isNotNull() & (F.col("test_mae") <= F.col("test_rmse") + 1e-9)
    return found.select("station", "h", "target", "train_n", "test_n", "n_left_out", measured.alias("measured"))
