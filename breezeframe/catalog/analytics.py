"""Lead-lag, autocorrelation, interactions, rankings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from breezeframe.catalog.aggregates import lead_corr_sql
from breezeframe.catalog.registry import query
from breezeframe.fixtures import PANEL, panel_hourly
from breezeframe.functions.features import pm_weather_pairs
from breezeframe.operators import aggregates as A
from breezeframe.operators import analytics as T
from breezeframe.operators import windows as W

FEATS = ["temperature", "humidity", "pressure", "wind_speed", "ozone", "nh3"]
HZ = [1, 6, 12, 24, 48, 72]
TG = ["pm2_5", "pm10"]
LEADS = [0, 3, 6, 12, 24, 48, 72]


def case(v: str, steps, last: str) -> str:
    return "CASE WHEN " + v + " IS NULL THEN NULL " + " ".join(f"WHEN {v} > {x} THEN '{t}'" for x, t in steps) + f" ELSE '{last}' END"


@query("t1_lead_lag_corr", f"WITH {PANEL}, {lead_corr_sql(FEATS, TG, HZ)} SELECT * FROM ll", dbl="r")
def t1(spark, sf):
    return T.lead_lag_corr(panel_hourly(spark, sf), FEATS, TG, HZ)


_WX = ["temperature", "humidity", "wind_speed"]
_WXL = f"{lead_corr_sql(_WX, TG, LEADS)}, wl AS (SELECT * FROM ll WHERE n > 20 AND r IS NOT NULL AND NOT isnan(r))"


@query("t2_weather_lead_lag", f"WITH {PANEL}, {_WXL} SELECT * FROM wl", dbl="r")
def t2(spark, sf):
    return T.weather_lead_lag(panel_hourly(spark, sf), _WX)


LAGS = {f"pm2_5_lag_{k}h": ("pm2_5", k) for k in (1, 3, 12, 24)}
STATS = [(s, h) for h in (3, 24) for s in ("mean", "max")]
ROLLS = {f"pm2_5_rolling_{s}_{h}h": ("pm2_5", h) for s, h in STATS}
EHZ = [6, 12, 24, 48, 72]

_FEATURED = (
    "feat AS (SELECT *, "
    + ", ".join(f"lag(pm2_5, {k}) OVER w AS {n}" for n, (_, k) in LAGS.items())
    + ", "
    + ", ".join(
        f"CASE WHEN count(*) OVER w{h} >= 2 THEN {'avg' if s == 'mean' else s}(pm2_5) OVER w{h} END AS pm2_5_rolling_{s}_{h}h" for s, h in STATS
    )
    + " FROM panel WINDOW w AS (PARTITION BY station ORDER BY time), "
    + ", ".join(f"w{h} AS (PARTITION BY station ORDER BY time RANGE BETWEEN INTERVAL {h} HOURS PRECEDING AND CURRENT ROW)" for h in (3, 24))
    + ")"
)
_EFF_L = (
    f"{lead_corr_sql(LAGS, ['pm2_5'], EHZ, 'feat')}, e AS (SELECT * FROM ll WHERE n > 10 AND r IS NOT NULL AND NOT isnan(r) AND ("
    + " OR ".join(f"(x = '{n}' AND h > {k})" for n, (_, k) in LAGS.items()) + "))"
)
_EFF_R = f"{lead_corr_sql(ROLLS, ['pm2_5'], EHZ, 'feat')}, e AS (SELECT * FROM ll WHERE n > 10 AND r IS NOT NULL AND NOT isnan(r))"
_TOP = "k AS (SELECT *, row_number() OVER (PARTITION BY station, target, h ORDER BY round(abs(r), 12) DESC, x) AS rank FROM e)"
_SUMMARY = (
    "SELECT *, " + case("avg_abs_r", [(0.6, "Excellent"), (0.4, "Good"), (0.2, "Moderate")], "Poor")
    + " AS quality FROM (SELECT station, target, h, max(x) FILTER (rank = 1) AS best, avg(abs(r)) AS avg_abs_r FROM k WHERE rank <= 3 GROUP BY ALL)"
)


def _featured(spark, sf):
    p = panel_hourly(spark, sf).select("station", "time", "seq", "pm2_5")
    p = W.shift(p, LAGS)
    return W.window_features(p, rolls=[W.Rolling(f"pm2_5_rolling_{s}_{h}h", "pm2_5", h, s) for s, h in STATS])


def _lag_effect(spark, sf):
    return T.effectiveness(_featured(spark, sf), LAGS, EHZ, only_shorter=True)


@query("t3_lag_effectiveness", f"WITH {PANEL}, {_FEATURED}, {_EFF_L}, {_TOP} {_SUMMARY}", dbl="avg_abs_r")
def t3(spark, sf):
    return T.effectiveness_summary(_lag_effect(spark, sf))


@query("t4_rolling_effectiveness", f"WITH {PANEL}, {_FEATURED}, {_EFF_R}, {_TOP} {_SUMMARY}", dbl="avg_abs_r")
def t4(spark, sf):
    return T.effectiveness_summary(T.effectiveness(_featured(spark, sf), ROLLS, EHZ))


@query(
    "t5_utility",
    f"""WITH {PANEL}, {_FEATURED}, {_EFF_L}, {_TOP} SELECT station, target, x, count(*) FILTER (rank <= 3) / max(hz)::DOUBLE AS utility, avg(abs(r)) AS importance
FROM k JOIN (SELECT station, target, count(DISTINCT h) AS hz FROM e GROUP BY ALL) USING (station, target) GROUP BY station, target, x""",
    dbl="utility importance",
)
def t5(spark, sf):
    return T.utility(_lag_effect(spark, sf))


_BEST = "b AS (SELECT station, target, h, arg_max(x, abs(r)) AS best, max(abs(r)) AS best_abs_r, avg(abs(r)) AS avg_abs_r FROM wl GROUP BY ALL)"


@query(
    "t6_best_predictor",
    f"WITH {PANEL}, {_WXL}, {_BEST} SELECT *, "
    + case("avg_abs_r", [(0.3, "Strong"), (0.2, "Moderate"), (0.1, "Weak")], "Very limited") + " AS assessment FROM b",
    dbl="best_abs_r avg_abs_r",
)
def t6(spark, sf):
    return T.best_predictor(T.weather_lead_lag(panel_hourly(spark, sf), _WX))


def days_sql(src: str) -> str:
    v = lambda h: f"coalesce(max(avg_abs_r) FILTER (h = {h}), 0)"
    return (
        f"(SELECT station, target, ({v(6)} + {v(12)} + {v(24)}) / 3 AS day1, ({v(36)} + {v(48)}) / 2 AS day2, {v(72)} AS day3 FROM {src} GROUP BY station, target)"
    )


@query("t6b_day_means", f"WITH {PANEL}, {_WXL}, {_BEST} SELECT * FROM {days_sql('b')}", dbl="day1 day2 day3")
def t6b(spark, sf):
    return T.day_means(T.best_predictor(T.weather_lead_lag(panel_hourly(spark, sf), _WX)))


def acf_sql(max_lag: int) -> str:
    """CTE ac(station, lag, r, n) over known rows by a self-join on row number."""
    return f"""kn AS (SELECT station, pm2_5 - avg(pm2_5) OVER (PARTITION BY station) AS x, row_number() OVER (PARTITION BY station ORDER BY time) AS i
 FROM panel WHERE pm2_5 IS NOT NULL),
ac AS (SELECT a.station, CAST(lag AS INTEGER) AS lag, sum(a.x * b.x) / max(v.d) AS r, max(v.n) AS n
 FROM (SELECT *, unnest(range(0, {max_lag + 1})) AS lag FROM kn) a
 JOIN kn b ON a.station = b.station AND b.i = a.i + lag JOIN (SELECT station, sum(x * x) AS d, count(*) AS n FROM kn GROUP BY 1) v ON v.station = a.station
 GROUP BY ALL)"""


_PRED = [(0.7, "Excellent"), (0.5, "Good"), (0.3, "Moderate"), (0.1, "Weak")]


@query(
    "t7_acf",
    f"WITH {PANEL}, {acf_sql(72)} SELECT station, lag, r, n, {case('abs(r)', _PRED, 'Very Weak')} AS label FROM ac",
    dbl="r",
)
def t7(spark, sf):
    return T.acf(panel_hourly(spark, sf), "pm2_5")


@query("t8_pacf")
def t8(spark, sf):
    return T.pacf(panel_hourly(spark, sf), "pm2_5")


def chi2_sql(q: str, k: int) -> str:
    """Tail for an even number of degrees: exp(-q/2) * sum (q/2)^i / i!."""
    return f"exp(-({q}) / 2) * (" + " + ".join(f"pow(({q}) / 2, {i}) / {math.factorial(i)}" for i in range(k // 2)) + ")"


def erfc_sql(x: str) -> str:
    """1 - erf by the series exp(-x^2) * sum 2^(i+1) x^(2i+1) / (2i+1)!! / sqrt(pi); nil beyond 6."""
    term = f"exp((i + 1) * ln(2) + (2 * i + 1) * ln({x}) - ln(2) * -(i + 1) - lgamma(2 * i + 3) + lgamma(i + 2) - {x} * {x})"
    return f"(CASE WHEN {x} > 6 THEN 0 ELSE 1 - list_sum(list_transform(range(0, 250), lambda i: {term})) / sqrt(pi()) END)"


def chi2_odd_sql(q: str, k: int) -> str:
    """Tail for an odd number of degrees: erfc(sqrt(q/2)) + exp(-q/2) * sum (q/2)^(i-1/2) / gamma(i+1/2)."""
    more = [f"exp(({i} - 0.5) * ln(({q}) / 2) - lgamma({i} + 0.5) - ({q}) / 2)" for i in range(1, (k - 1) // 2 + 1)]
    return " + ".join([erfc_sql(f"sqrt(({q}) / 2)"), *more])


_TAILS = " ".join(f"WHEN {k} THEN {chi2_odd_sql('q', k) if k % 2 else chi2_sql('q', k)}" for k in range(1, 25))


@query(
    "t9_ljung_box",
    f"""WITH {PANEL}, {acf_sql(24)}, lb AS (SELECT station, lag, n * (n + 2) * sum(r * r / (n - lag)) OVER (PARTITION BY station ORDER BY lag) AS q
FROM ac WHERE lag > 0) SELECT station, lag, q, p_value, p_value < 0.05 AS significant FROM (SELECT *, CASE lag {_TAILS} END AS p_value FROM lb)""",
    dbl="q p_value",
)
def t9(spark, sf):
    return T.ljung_box(panel_hourly(spark, sf), "pm2_5")


@query(
    "t9b_ljung_box_verdict",
    f"""WITH {PANEL}, {acf_sql(24)}, lb AS (SELECT station, lag, n * (n + 2) * sum(r * r / (n - lag)) OVER (PARTITION BY station ORDER BY lag) AS q
FROM ac WHERE lag > 0) SELECT station, count(*) AS lags, count(*) FILTER (p_value < 0.05) AS significant_lags
FROM (SELECT *, CASE lag {_TAILS} END AS p_value FROM lb) GROUP BY station""",
)
def t9b(spark, sf):
    return T.ljung_box_verdict(T.ljung_box(panel_hourly(spark, sf), "pm2_5"))


PAIRS = pm_weather_pairs(TG, ["temperature", "humidity"])


def gain_sql(pairs: dict, targets, src: str = "panel") -> str:
    return "g AS (" + " UNION ALL ".join(
        f"SELECT station, '{t}' AS target, '{n}' AS interaction, corr({t}, {a} * {b}) AS r, greatest(abs(corr({t}, {a})), abs(corr({t}, {b}))) AS best_part FROM {src} GROUP BY station"
        for n, (a, b) in pairs.items() for t in targets
    ) + ")"


_GAIN = "SELECT *, abs(r) - best_part AS gain, abs(r) - best_part > 0 AS improves, abs(r) > 0.1 AND abs(r) - best_part > 0.01 AS useful FROM g"


@query("t10_interaction_gain", f"WITH {PANEL}, {gain_sql(PAIRS, TG)} {_GAIN}", dbl="r best_part gain")
def t10(spark, sf):
    return T.interaction_gain(panel_hourly(spark, sf), PAIRS)


_PH = [1, 24]
_PAST = {t: {f"{t}_past_{h}h_{w}_interaction": (f"{t}_past_{h}h", w) for h in _PH for w in ["temperature", "wind_speed"]} for t in TG}
_PASTED = "pst AS (SELECT *, " + ", ".join(f"lag({t}, {h}) OVER w AS {t}_past_{h}h" for t in TG for h in _PH) + " FROM panel WINDOW w AS (PARTITION BY station ORDER BY time))"
_PAST_SQL = (
    f"{_PASTED}, {gain_sql(_PAST['pm2_5'], ['pm2_5'], 'pst').replace('g AS', 'g1 AS', 1)}, "
    f"{gain_sql(_PAST['pm10'], ['pm10'], 'pst').replace('g AS', 'g2 AS', 1)}, g AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2)"
)


@query("t10b_past_pm_weather", f"WITH {PANEL}, {_PAST_SQL} {_GAIN}", dbl="r best_part gain")
def t10b(spark, sf):
    return T.past_pm_weather(panel_hourly(spark, sf), ["temperature", "wind_speed"], _PH)


@query(
    "t10c_improvement_rate",
    f"WITH {PANEL}, {_PAST_SQL} SELECT station, count(*) AS total, avg((useful)::INT) * 100 AS percent FROM ({_GAIN}) WHERE r IS NOT NULL GROUP BY station",
    dbl="percent",
)
def t10c(spark, sf):
    return T.improvement_rate(T.past_pm_weather(panel_hourly(spark, sf), ["temperature", "wind_speed"], _PH), "useful")


@query(
    "t11_persistence_corr",
    f"WITH {PANEL}, {lead_corr_sql(TG, TG, HZ)} SELECT station, target, h, r, n FROM ll WHERE x = target",
    dbl="r",
)
def t11(spark, sf):
    return T.persistence_corr(panel_hourly(spark, sf))


_PERS = f"{lead_corr_sql(['pm2_5'], ['pm2_5'], [6, 12, 24, 36, 48, 72]).replace('ll AS', 'pl AS', 1)}, pa AS (SELECT station, target, h, abs(r) AS avg_abs_r FROM pl)"


@query(
    "t12_feasibility",
    f"""WITH {PANEL}, {_FEATURED}, {_EFF_L}, {_TOP}, ls AS ({_SUMMARY}), {_PERS},
{lead_corr_sql(_WX, ['pm2_5'], LEADS).replace('ll AS', 'wll AS', 1)}, wb AS (SELECT station, target, h, avg(abs(r)) AS avg_abs_r FROM wll WHERE n > 20 GROUP BY ALL),
s AS (SELECT a.station, a.target, (a.day1 + l.day1 + w.day1) / 3 AS day1_score, (a.day2 + l.day2 + w.day2) / 3 AS day2_score, (a.day3 + l.day3 + w.day3) / 3 AS day3_score
 FROM {days_sql('pa')} a JOIN {days_sql('ls')} l USING (station, target) JOIN {days_sql('wb')} w USING (station, target))
SELECT *, {case('day1_score', [(0.5, 'Excellent'), (0.4, 'Good'), (0.3, 'Moderate')], 'Challenging')} AS day1_label,
{case('day2_score', [(0.4, 'Good'), (0.3, 'Moderate'), (0.2, 'Challenging')], 'Difficult')} AS day2_label,
{case('day3_score', [(0.3, 'Feasible'), (0.2, 'Challenging'), (0.15, 'Difficult')], 'Very difficult')} AS day3_label FROM s""",
    dbl="day1_score day2_score day3_score",
)
def t12(spark, sf):
    p = panel_hourly(spark, sf)
    auto = T.persistence_corr(p, ["pm2_5"], [6, 12, 24, 36, 48, 72]).withColumn("avg_abs_r", F.abs("r"))
    lags = T.effectiveness_summary(_lag_effect(spark, sf))
    wx = T.best_predictor(T.weather_lead_lag(p, _WX, ["pm2_5"]))
    return T.feasibility(T.day_means(auto), T.day_means(lags), T.day_means(wx))


_CATS = {"weather": FEATS[:4], "pollutants": FEATS[4:]}


@query(
    "o3_top_features",
    f"""WITH {PANEL}, c AS ({" UNION ALL ".join(f"SELECT station, '{t}' AS target, '{x}' AS x, corr({x}, {t}) AS r, CASE WHEN '{x}' IN ('ozone', 'nh3') THEN 'pollutants' ELSE 'weather' END AS category FROM panel GROUP BY station" for x in FEATS for t in TG)})
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY station, target ORDER BY round(abs(r), 12) DESC, x) AS INTEGER) AS rank,
x = first(x) OVER (PARTITION BY station, target, category ORDER BY round(abs(r), 12) DESC, x) AS best_of_category FROM c) WHERE rank <= 4""",
    dbl="r",
)
def o3(spark, sf):
    c = A.corr_pairs(panel_hourly(spark, sf), [(x, t) for x in FEATS for t in TG], names=("x", "target")).drop("n")
    return T.top_features(c, 4, _CATS)


@query(
    "w16_topk_by_abs",
    f"WITH {PANEL}, {lead_corr_sql(FEATS, TG, HZ)} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY station, target, h ORDER BY round(abs(r), 12) DESC, x) AS INTEGER) AS rank FROM ll) WHERE rank <= 3",
    dbl="r",
)
def w16(spark, sf):
    return T.topk_by_abs(T.lead_lag_corr(panel_hourly(spark, sf), FEATS, TG, HZ), 3, ["station", "target", "h"], "x")
