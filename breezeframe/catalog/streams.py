"""Streaming jobs driven to completion over stored documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeframe import fixtures as X
from breezeframe.catalog.registry import query
from breezeframe.catalog.scalars import BP, category_sql, strict_sql
from breezeframe.catalog.windows import lag_sql
from breezeframe.fixtures import PANEL, panel_hourly
from breezeframe.operators import windows as W
from breezeframe.schema import AQI_CATEGORIES
from breezeframe.session import scratch_path
from breezeframe.sources import store
from breezeframe.streaming import jobs


def _documents(spark, sf) -> str:
    """Folder with the payload documents dealt over files without regard to time: a ninth
    component in one station's, one document in ten cut off and delivered whole later, and half
    of all once more, as late deliveries and replays would leave it."""
    path = scratch_path(spark, "documents")
    docs = X.pollution_json(spark, sf)
    ninth = F.replace("payload", F.lit('"co":'), F.lit('"xyz":1.5,"co":'))
    docs = docs.withColumn("payload", F.when(F.col("station") == "view", ninth).otherwise(F.col("payload")))
    broken = docs.where(F.pmod(F.xxhash64("payload"), F.lit(10)) == 0).select("station", F.expr("left(payload, 40)").alias("payload"))
    docs.unionByName(broken).repartition(6, F.xxhash64("payload")).write.parquet(path)
    again = docs.where(F.pmod(F.xxhash64("payload"), F.lit(2)) == 0)
    again.repartition(2, F.xxhash64("payload")).write.mode("append").parquet(path)
    return path


@query(
    "x1_hourly_ingest",
    f"""WITH {PANEL} SELECT station, time, strftime(time, '%Y-%m-%d %H:%M:%S') AS time_str, carbon_monoxide, no, nitrogen_dioxide,
ozone, sulphur_dioxide, pm2_5, pm10, nh3, CASE WHEN station = 'view' AND carbon_monoxide IS NOT NULL THEN 1.5::DOUBLE END AS xyz FROM panel""",
)
def x1(spark, sf):
    out, rejects = scratch_path(spark, "ingested"), scratch_path(spark, "rejects")
    stream = jobs.read_documents(spark, _documents(spark, sf), files_per_batch=2)
    jobs.run_updates(stream, jobs.hourly_ingest(out, rejects), scratch_path(spark, "ckpt"))
    return store.read_table(spark, out).drop("date", "openweather_aqi")


_LAGS = [W.Lag("pm2_5_lag_1h", "pm2_5", 1), W.Lag("pm2_5_lag_24h", "pm2_5", 24)]
_ROLLS = [W.Rolling("pm2_5_rolling_mean_3h", "pm2_5", 3, "mean")]


@query(
    "x2_feature_updates",
    f"""WITH {PANEL}, a AS ({lag_sql('pm2_5', 1, 30, 'panel')}), b AS ({lag_sql('pm2_5', 24, 60, 'panel')})
SELECT p.station, p.time, strftime(p.time, '%Y-%m-%d %H:%M:%S') AS time_str, p.pm2_5, a.v AS pm2_5_lag_1h, b.v AS pm2_5_lag_24h,
CASE WHEN count(*) OVER w3 >= 2 THEN avg(p.pm2_5) OVER w3 END AS pm2_5_rolling_mean_3h
FROM panel p LEFT JOIN a USING (station, seq) LEFT JOIN b USING (station, seq)
WINDOW w3 AS (PARTITION BY p.station ORDER BY p.time RANGE BETWEEN INTERVAL 3 HOURS PRECEDING AND CURRENT ROW)""",
    dbl="pm2_5_rolling_mean_3h",
)
def x2(spark, sf):
    rows, raw, feats = (scratch_path(spark, n) for n in ("rows", "raw", "features"))
    p = panel_hourly(spark, sf).select("station", "time", "pm2_5")
    # two arrivals: every third hour comes late
    late = F.pmod(F.unix_seconds("time") / 3600, F.lit(3)) == 0
    p.filter(~late).repartition(2, "station").write.parquet(rows)
    p.filter(late).repartition(2, "station").write.mode("append").parquet(rows)
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 2).parquet(rows)
    handler = jobs.feature_updates(raw, feats, _LAGS, _ROLLS, columns=["pm2_5"])
    jobs.run_updates(stream, handler, scratch_path(spark, "ckpt"))
    return store.read_table(spark, feats).drop("date")


_COUNTS = ", ".join(
    f"count(*) FILTER (cat = '{n}') AS n_{n.lower().replace(' ', '_')}" for n, *_ in AQI_CATEGORIES
)


@query(
    "x3_sliding_stats",
    f"""WITH {PANEL}, {BP}, c AS (SELECT station, time, pm2_5, {category_sql('us')} AS cat FROM (SELECT *,
CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END AS us FROM (SELECT *, {strict_sql('pm2_5', 'pm2_5')} AS a, {strict_sql('pm10', 'pm10')} AS b FROM panel)))
SELECT station, ws AS window_start, ws + INTERVAL 24 HOUR AS window_end, avg(pm2_5) AS pm2_5_mean, min(pm2_5) AS pm2_5_min, max(pm2_5) AS pm2_5_max,
count(pm2_5) AS n, {_COUNTS} FROM (SELECT *, time - to_hours(k) AS ws FROM (SELECT *, unnest(range(0, 24)) AS k FROM c)) GROUP BY station, ws""",
    dbl="pm2_5_mean",
)
def x3(spark, sf):
    rows, hours, out = (scratch_path(spark, n) for n in ("rows", "hours", "stats"))
    p = panel_hourly(spark, sf).select("station", "time", "pm2_5", "pm10")
    p.write.parquet(rows)
    stream = spark.readStream.schema(p.schema).parquet(rows)
    jobs.run_updates(jobs.bucket_stats(stream), jobs.keep_windows(hours, out), scratch_path(spark, "ckpt"), "update")
    return store.read_table(spark, out).drop("date")
