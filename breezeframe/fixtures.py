"""Readings, hourly panel and forecast inputs derived from the shared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breezeframe.schema import MEASURES

# keeps exact decimal ties away from the rounding edge, where summation order would decide
TIE_NUDGE = 3.7e-9


def round6(c: Column) -> Column:
    return F.round(c + F.lit(TIE_NUDGE), 6)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular observations: five stations, null and zero readings at fixed ids."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("station"),
        F.col("ts").cast("timestamp").alias("time"),
        F.col("event_id").alias("seq"),
        "user_id",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    v, k, u, i = F.col("value"), F.col("k"), F.col("user_id"), F.col("seq")
    return e.select(
        "station",
        "time",
        "seq",
        F.when(i % 17 != 0, v).alias("pm2_5"),
        F.when(i % 101 == 0, v - 1).otherwise(v + k).alias("pm10"),
        (2.0 + 0.4 * k).alias("temperature"),
        ((k * 37) % 101).cast("double").alias("humidity"),
        (1000 + u % 30).cast("double").alias("pressure"),
        (u % 25).cast("double").alias("wind_speed"),
        F.when(i % 23 != 0, (u * 7) % 361).cast("double").alias("wind_direction"),
        (v * 100).alias("carbon_monoxide"),
        (k * 2.0).alias("ozone"),
        F.when(i % 29 == 0, 0.0).otherwise(v / 4).alias("sulphur_dioxide"),
        (k + v).alias("nitrogen_dioxide"),
        (k / 10.0).alias("no"),
        (v / 10).alias("nh3"),
    )


READINGS = """
readings AS (
  SELECT station, time, seq,
         CASE WHEN seq % 17 = 0 THEN NULL ELSE value END AS pm2_5,
         CASE WHEN seq % 101 = 0 THEN value - 1 ELSE value + k END AS pm10,
         CAST(2.0 AS DOUBLE) + CAST(0.4 AS DOUBLE) * k AS temperature,
         CAST((k * 37) % 101 AS DOUBLE) AS humidity,
         CAST(1000 + user_id % 30 AS DOUBLE) AS pressure,
         CAST(user_id % 25 AS DOUBLE) AS wind_speed,
         CASE WHEN seq % 23 = 0 THEN NULL ELSE CAST((user_id * 7) % 361 AS DOUBLE) END AS wind_direction,
         value * 100 AS carbon_monoxide,
         k * CAST(2.0 AS DOUBLE) AS ozone,
         CASE WHEN seq % 29 = 0 THEN CAST(0.0 AS DOUBLE) ELSE value / 4 END AS sulphur_dioxide,
         k + value AS nitrogen_dioxide,
         k / CAST(10.0 AS DOUBLE) AS no,
         value / 10 AS nh3
  FROM (SELECT event_type AS station, CAST(ts AS TIMESTAMP) AS time, event_id AS seq, user_id, value,
               CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k
        FROM events)
)"""


def panel_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per station and hour; hours without readings are null rows."""
    r = readings(spark, sf_dir)
    hourly = r.groupBy("station", F.date_trunc("hour", "time").alias("time")).agg(
        *[round6(F.avg(c)).alias(c) for c in MEASURES]
    )
    spans = r.groupBy("station").agg(
        F.date_trunc("hour", F.min("time")).alias("lo"), F.date_trunc("hour", F.max("time")).alias("hi")
    )
    grid = spans.select(
        "station", F.explode(F.expr("sequence(lo, hi, interval 1 hour)")).alias("time")
    )
    return grid.join(hourly, ["station", "time"], "left").select(
        "station", "time", F.unix_seconds("time").alias("seq"), *MEASURES
    )


PANEL = (
    READINGS
    + """,
hourly AS (
  SELECT station, date_trunc('hour', time) AS time, """
    + ", ".join(f"round(avg({c}) + 3.7e-9, 6) AS {c}" for c in MEASURES)
    + """
  FROM readings GROUP BY ALL
),
panel AS (
  SELECT g.station, g.time, CAST(epoch(g.time) AS BIGINT) AS seq, """
    + ", ".join(f"h.{c}" for c in MEASURES)
    + """
  FROM (SELECT station, unnest(generate_series(date_trunc('hour', min(time)),
                                               date_trunc('hour', max(time)), INTERVAL 1 HOUR)) AS time
        FROM readings GROUP BY station) g
  LEFT JOIN hourly h USING (station, time)
)"""
)


# --- payload documents ---------------------------------------------------------------


def pollution_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per station and day; every seventh hour lacks ``main``."""
    p = panel_hourly(spark, sf_dir)
    names = {
        "co": "carbon_monoxide", "no": "no", "no2": "nitrogen_dioxide", "o3": "ozone",
        "so2": "sulphur_dioxide", "pm2_5": "pm2_5", "pm10": "pm10", "nh3": "nh3",
    }
    parts = F.struct(*[F.col(c).alias(n) for n, c in names.items()])
    item = F.struct(
        F.col("seq").alias("dt"),
        F.when(F.hour("time") % 7 != 0, F.struct((F.hour("time") % 5 + 1).alias("aqi"))).alias("main"),
        parts.alias("components"),
    )
    return _documents(p, item)


def weather_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per station and day; some hours lack ``main`` or ``wind``."""
    p = panel_hourly(spark, sf_dir)
    item = F.struct(
        F.col("seq").alias("dt"),
        F.when(
            F.hour("time") % 11 != 0,
            F.struct(F.col("temperature").alias("temp"), "humidity", "pressure"),
        ).alias("main"),
        F.when(
            F.hour("time") % 5 != 0,
            F.struct(F.col("wind_speed").alias("speed"), F.col("wind_direction").alias("deg")),
        ).alias("wind"),
    )
    return _documents(p, item)


def _documents(p: DataFrame, item: Column) -> DataFrame:
    # a day has at most 24 hours, so the list is bounded
    docs = p.groupBy("station", F.to_date("time").alias("day")).agg(
        F.sort_array(F.collect_list(item)).alias("list")
    )
    return docs.select("station", F.to_json(F.struct("list")).alias("payload"))


def forecast_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 72 grid hours of each station as a weather forecast."""
    return _last_hours(panel_hourly(spark, sf_dir)).select(
        "station", "step_hour", F.col("time").alias("target_time"),
        "temperature", "humidity", "pressure", "wind_speed", "wind_direction",
    )


def forecast_pollution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hours as a pollution forecast, one hour early at two stations."""
    early = F.col("station").isin("click", "view").cast("int")
    return _last_hours(panel_hourly(spark, sf_dir)).select(
        "station", "step_hour",
        (F.col("time") - F.make_interval(hours=early)).alias("target_time"),
        "carbon_monoxide", "ozone", "sulphur_dioxide", "nh3",
    )


def _last_hours(p: DataFrame, n: int = 72) -> DataFrame:
    end = p.groupBy("station").agg(F.max("time").alias("_end"))
    step = n - (F.unix_seconds("_end") - F.unix_seconds("time")) / 3600
    return p.join(end, "station").withColumn("step_hour", step.cast("int")).filter("step_hour >= 1")


LAST_HOURS = """
ends AS (SELECT station, max(time) AS hi FROM panel GROUP BY station),
fc AS (SELECT p.*, CAST(72 - date_diff('hour', p.time, hi) AS INTEGER) AS step_hour
       FROM panel p JOIN ends USING (station) WHERE date_diff('hour', p.time, hi) < 72)"""


# --- forecasts to score --------------------------------------------------------------


def predictions(spark: SparkSession, sf_dir: str, horizons=None) -> DataFrame:
    """Persistence forecast: the value at the base hour predicts every horizon."""
    from breezeframe.operators.frames import targets_long
    from breezeframe.schema import REPORT_HORIZONS, TARGETS

    long = targets_long(panel_hourly(spark, sf_dir), TARGETS, horizons or REPORT_HORIZONS)
    return long.filter(F.col("y").isNotNull() & F.col("y_base").isNotNull()).select(
        "station", F.col("time").alias("base_time"), "h", "target",
        F.col("y").alias("y_true"), F.col("y_base").alias("y_pred"),
    )


PREDICTIONS = (
    PANEL
    + """,
base AS (SELECT station, time, target, v FROM panel UNPIVOT INCLUDE NULLS (v FOR target IN (pm2_5, pm10))),
predictions AS (
  SELECT b.station, b.time AS base_time, CAST(h AS INTEGER) AS h, b.target, t.v AS y_true, b.v AS y_pred
  FROM base b, (VALUES (1), (6), (12), (24), (48), (72)) hs(h)
  JOIN base t ON t.station = b.station AND t.target = b.target AND t.time = b.time + to_hours(h)
  WHERE t.v IS NOT NULL AND b.v IS NOT NULL
)"""
)


def monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference-monitor readings: index of the hourly PM2.5 mean plus an hour offset."""
    from breezeframe.functions.aqi import aqi_strict

    value = aqi_strict(F.col("pm2_5"), "pm2_5") + F.hour("time") % 5
    return panel_hourly(spark, sf_dir).select("station", "time", value.alias("iqair_aqi"))
