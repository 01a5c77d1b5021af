"""Payload flattening, scans, lookups, keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from breezeframe import fixtures as X
from breezeframe.catalog.registry import query
from breezeframe.catalog.scalars import BP, strict_sql
from breezeframe.fixtures import LAST_HOURS, PANEL, READINGS, panel_hourly, readings
from breezeframe.functions.aqi import aqi_strict
from breezeframe.functions.features import time_key
from breezeframe.operators.scaling import fit_scaler
from breezeframe.schema import MEASURES
from breezeframe.session import scratch_path
from breezeframe.sources import payloads as P
from breezeframe.sources import store, tables


@query(
    "s1_flatten_pollution",
    f"""WITH {PANEL} SELECT station, time, carbon_monoxide AS co, no, nitrogen_dioxide AS no2, ozone AS o3,
sulphur_dioxide AS so2, pm2_5, pm10, nh3,
CASE WHEN hour(time) % 7 <> 0 THEN CAST(hour(time) % 5 + 1 AS INTEGER) END AS openweather_aqi FROM panel""",
)
def s1(spark, sf):
    return P.flatten_pollution(X.pollution_json(spark, sf))


@query(
    "s1b_dynamic_components",
    f"""WITH {PANEL} SELECT station, time, carbon_monoxide AS co, no, nitrogen_dioxide AS no2, ozone AS o3,
sulphur_dioxide AS so2, pm2_5, pm10, nh3, CASE WHEN carbon_monoxide IS NOT NULL THEN 1.5::DOUBLE END AS xyz,
CASE WHEN hour(time) % 7 <> 0 THEN CAST(hour(time) % 5 + 1 AS INTEGER) END AS openweather_aqi FROM panel""",
)
def s1b(spark, sf):
    docs = X.pollution_json(spark, sf).withColumn("payload", F.replace("payload", F.lit('"co":'), F.lit('"xyz":1.5,"co":')))
    return P.flatten_pollution(docs, components="all")


_WX_SQL = """CASE WHEN hour(time) % 11 <> 0 THEN temperature END AS temperature,
CASE WHEN hour(time) % 11 <> 0 THEN humidity END AS humidity, CASE WHEN hour(time) % 11 <> 0 THEN pressure END AS pressure,
CASE WHEN hour(time) % 5 <> 0 THEN wind_speed END AS wind_speed,
CASE WHEN hour(time) % 5 <> 0 THEN wind_direction END AS wind_direction"""


@query("s2_flatten_weather", f"WITH {PANEL} SELECT station, time, {_WX_SQL} FROM panel")
def s2(spark, sf):
    return P.flatten_weather(X.weather_json(spark, sf))


@query(
    "s3_flatten_weather_current",
    f"WITH {READINGS} SELECT station, seq, temperature, humidity, pressure, wind_speed, wind_direction FROM readings",
)
def s3(spark, sf):
    item = F.struct(
        F.unix_seconds("time").alias("dt"),
        F.struct(F.col("temperature").alias("temp"), "humidity", "pressure").alias("main"),
        F.struct(F.col("wind_speed").alias("speed"), F.col("wind_direction").alias("deg")).alias("wind"),
    )
    r = readings(spark, sf)
    return P.flatten_weather_current(r.select("station", "seq", F.to_json(item).alias("payload")))


MONITOR_SQL = f"""monitor AS (SELECT station, time, CAST({strict_sql('pm2_5', 'pm2_5')} + hour(time) % 5 AS INTEGER) AS iqair_aqi FROM panel)"""


@query(
    "s4_flatten_monitor_aqi",
    f"WITH {PANEL}, {BP}, {MONITOR_SQL} SELECT station, time, iqair_aqi FROM monitor WHERE hour(time) % 6 <> 0",
)
def s4(spark, sf):
    p = panel_hourly(spark, sf)
    reading = F.struct(
        F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"),
        (aqi_strict(F.col("pm2_5"), "pm2_5") + F.hour("time") % 5).alias("aqius"),
    )
    doc = F.struct(
        F.when(F.hour("time") % 6 != 0, "success").otherwise("fail").alias("status"),
        F.struct(F.struct(reading.alias("pollution")).alias("current")).alias("data"),
    )
    return P.flatten_monitor_aqi(p.select("station", F.to_json(doc).alias("payload")))


@query(
    "s5_flatten_forecast",
    f"""WITH {PANEL} SELECT station, CAST(row_number() OVER (PARTITION BY station, date_trunc('day', time) ORDER BY time) AS INTEGER)
AS step_hour, time AS target_time, {_WX_SQL} FROM panel""",
)
def s5(spark, sf):
    return P.flatten_forecast(X.weather_json(spark, sf))


@query(
    "s6_flatten_pollution_forecast",
    f"""WITH {PANEL} SELECT * FROM (SELECT station, CAST(row_number() OVER (PARTITION BY station, date_trunc('day', time)
ORDER BY time) AS INTEGER) AS step_hour, time AS target_time, carbon_monoxide, ozone, sulphur_dioxide, nh3 FROM panel)
WHERE step_hour <= 12""",
)
def s6(spark, sf):
    return P.flatten_pollution_forecast(X.pollution_json(spark, sf), hours=12)


@query(
    "s6b_payload_variants",
    f"WITH {READINGS} SELECT station, seq, CASE WHEN seq % 4 <> 3 THEN coalesce(pm2_5, 0) ELSE 0 END AS pm2_5, "
    "CASE WHEN seq % 4 <> 3 THEN pm10 ELSE 0 END AS pm10 FROM readings",
)
def s6b(spark, sf):
    comp = F.struct("pm2_5", "pm10")
    i = F.col("seq") % 4
    doc = (
        F.when(i == 0, F.to_json(F.struct(F.array(F.struct(comp.alias("components"))).alias("list"))))
        .when(i == 1, F.to_json(F.array(F.struct(F.array(comp).alias("components")))))
        .when(i == 2, F.to_json(comp))
        .otherwise(F.lit("{}"))
    )
    r = readings(spark, sf).select("station", "seq", doc.alias("payload"))
    return r.select("station", "seq", *P.normalise_components(F.col("payload")))


_CSV = T.StructType(
    [T.StructField("station", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("time", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in MEASURES]
)


@query(
    "s7_read_csv_series",
    f"WITH {READINGS} SELECT station, seq, CASE WHEN seq % 13 <> 0 THEN time END AS time, {', '.join(MEASURES)} FROM readings",
)
def s7(spark, sf):
    path = scratch_path(spark, "csv")
    text = F.when(F.col("seq") % 13 != 0, F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise("not a time")
    r = readings(spark, sf).withColumn("time", text).select("station", "seq", "time", *MEASURES)
    tables.write_csv(r, path)
    return tables.read_csv_series(spark, path, _CSV)


@query(
    "s8_read_features",
    f"WITH {PANEL} SELECT station, time, seq, pm2_5, pm10 FROM panel WHERE hour(time) <> 5",
)
def s8(spark, sf):
    path = scratch_path(spark, "features")
    p = panel_hourly(spark, sf).withColumn("time_str", time_key())
    p.withColumn("time", F.when(F.hour("time") != 5, F.col("time"))).write.parquet(path)
    return tables.read_features(spark, path).select("station", "time", "seq", "pm2_5", "pm10")


@query(
    "s9_lookup_hours",
    f"""WITH {PANEL}, a AS (SELECT station, max(time) - INTERVAL 100 HOUR AS anchor FROM panel GROUP BY 1)
SELECT station, CASE WHEN time > anchor THEN 'forward' ELSE 'backward' END AS dir, time AS key_time,
strftime(time, '%Y-%m-%d %H:%M:%S') AS time_str, pm2_5, pm10 FROM panel JOIN a USING (station)
WHERE time > anchor - INTERVAL 72 HOUR AND time <= anchor + INTERVAL 72 HOUR""",
)
def s9(spark, sf):
    p = panel_hourly(spark, sf).select("station", "time", "pm2_5", "pm10")
    anchors = p.groupBy("station").agg((F.max("time") - F.expr("interval 100 hours")).alias("anchor"))
    back = tables.lookup_hours(p, anchors, 72, forward=False).withColumn("dir", F.lit("backward"))
    ahead = tables.lookup_hours(p, anchors, 72, forward=True).withColumn("dir", F.lit("forward"))
    return back.unionByName(ahead).drop("time")


@query(
    "s10_time_chunks",
    f"""WITH {READINGS}, s AS (SELECT station, min(time) AS lo, max(time) AS hi FROM readings GROUP BY 1)
SELECT station, chunk_start, least(chunk_start + INTERVAL 24 HOUR, hi) AS chunk_end,
(SELECT count(*) FROM readings r WHERE r.station = c.station AND r.time >= chunk_start
 AND r.time < least(chunk_start + INTERVAL 24 HOUR, hi)) AS n
FROM (SELECT station, hi, unnest(generate_series(lo, hi, INTERVAL 24 HOUR)) AS chunk_start FROM s) c WHERE chunk_start < hi""",
)
def s10(spark, sf):
    r = readings(spark, sf).select("station", "time")
    span = r.groupBy("station").agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    chunks = tables.time_chunks(span, "lo", "hi")
    # a reading's chunk follows from its distance to the start: an equi-join, no range join
    day = 24 * 3600 * 1_000_000
    n = F.call_function("div", F.unix_micros("time") - F.unix_micros("lo"), F.lit(day))
    counts = r.join(span, "station").filter("time < hi").groupBy("station", n.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    k = F.call_function("div", F.unix_micros("chunk_start") - F.unix_micros("lo"), F.lit(day))
    return chunks.withColumn("k", k).join(counts, ["station", "k"], "left").select(
        "station", "chunk_start", "chunk_end", F.coalesce("n", F.lit(0)).alias("n")
    )


@query(
    "s10b_read_chunks",
    f"""WITH {PANEL}, s AS (SELECT station, min(time) + INTERVAL 30 HOUR AS lo, max(time) AS hi FROM panel GROUP BY 1),
b AS (SELECT min(CAST(time AS DATE)) + 3 AS day FROM panel),
c AS (SELECT station, chunk_start, least(chunk_start + INTERVAL 24 HOUR, hi) AS chunk_end
FROM (SELECT station, hi, unnest(generate_series(lo, hi, INTERVAL 24 HOUR)) AS chunk_start FROM s) WHERE chunk_start < hi),
m AS (SELECT c.*, CAST(chunk_start AS DATE) <= b.day AND CAST(chunk_end - INTERVAL 1 MICROSECOND AS DATE) >= b.day AS broken FROM c, b)
SELECT m.station, chunk_start, chunk_end, broken, count(p.time) FILTER (NOT broken) AS n, avg(p.pm2_5) FILTER (NOT broken) AS mean
FROM m LEFT JOIN panel p ON p.station = m.station AND p.time >= chunk_start AND p.time < chunk_end GROUP BY m.station, chunk_start, chunk_end, broken""",
    dbl="mean",
)
def s10b(spark, sf):
    """Chunk-wise read of a table partitioned by day, one day of which is damaged."""
    path = scratch_path(spark, "days")
    p = panel_hourly(spark, sf).select("station", "time", "pm2_5").withColumn("date", F.to_date("time"))
    p.write.partitionBy("date").parquet(path)
    bad = p.agg(F.date_add(F.min("date"), 3)).first()[0]
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/date={bad}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        stream = files.create(status.getPath(), True)
        stream.write(bytearray(b"not parquet"))
        stream.close()
    span = p.groupBy("station").agg((F.min("time") + F.expr("interval 30 hours")).alias("lo"), F.max("time").alias("hi"))
    chunks = tables.time_chunks(span, "lo", "hi").drop("lo", "hi")
    found = tables.read_chunks(spark, path, chunks)
    by = ["station", "chunk_start", "chunk_end"]
    counts = found.rows.groupBy(*by).agg(F.count("time").alias("n"), F.avg("pm2_5").alias("mean"))
    listed = chunks.join(found.failed.select(*by, F.lit(True).alias("broken")), by, "left").join(counts, by, "left")
    return listed.select(*by, F.coalesce("broken", F.lit(False)).alias("broken"), F.coalesce("n", F.lit(0)).alias("n"), "mean")


@query("s11_write_csv", f"WITH {PANEL} SELECT station, seq, time, pm2_5, pm10 FROM panel")
def s11(spark, sf):
    path = scratch_path(spark, "export")
    cols = T.StructType([f for f in _CSV if f.name in ("station", "seq", "time", "pm2_5", "pm10")])
    tables.write_csv(panel_hourly(spark, sf).select(*cols.names), path)
    return spark.read.schema(cols).option("header", True).csv(path)


@query(
    "s12_append_monthly",
    f"""WITH {PANEL}, {BP}, {MONITOR_SQL}
SELECT station, time, iqair_aqi + CASE WHEN hour(time) % 3 = 0 THEN 1 ELSE 0 END AS iqair_aqi,
CASE WHEN hour(time) % 3 = 0 THEN 2 ELSE 1 END AS seq, strftime(time, '%Y%m') AS month FROM monitor""",
)
def s12(spark, sf):
    path = scratch_path(spark, "monthly")
    m = X.monitor(spark, sf)
    store.append_monthly(m.withColumn("seq", F.lit(1)), path)
    again = m.filter(F.hour("time") % 3 == 0).withColumn("iqair_aqi", F.col("iqair_aqi") + 1)
    store.append_monthly(again.withColumn("seq", F.lit(2)), path)
    return store.read_table(spark, path).withColumn("month", F.col("month").cast("string"))


@query("s13_write_training_set", f"WITH {PANEL} SELECT station, time, pm2_5 + 1 AS pm2_5, 2 AS version FROM panel", dbl="pm2_5")
def s13(spark, sf):
    path = scratch_path(spark, "training")
    p = panel_hourly(spark, sf).select("station", "time", "pm2_5")
    store.write_training_set(p, path, 1)
    store.write_training_set(p.withColumn("pm2_5", F.col("pm2_5") + 1), path, 2)
    return spark.read.parquet(path).filter(F.col("version") == 2)


@query(
    "s14_upsert_features",
    f"""WITH {PANEL} SELECT station, time, strftime(time, '%Y-%m-%d %H:%M:%S') AS time_str, strftime(time, '%Y-%m-%d') AS date,
CASE WHEN day(time) >= 28 THEN pm2_5 + 100 ELSE pm2_5 END AS pm2_5 FROM panel""",
    dbl="pm2_5",
)
def s14(spark, sf):
    path = scratch_path(spark, "upsert")
    p = panel_hourly(spark, sf).select("station", "time", "pm2_5")
    store.upsert_features(p, path)
    changed = p.filter(F.dayofmonth("time") >= 28).withColumn("pm2_5", F.col("pm2_5") + 100)
    store.upsert_features(changed, path)
    store.upsert_features(changed, path)
    return store.read_table(spark, path).withColumn("date", F.col("date").cast("string"))


@query("s15_register_view", f"WITH {PANEL} SELECT station, time, pm2_5 FROM panel WHERE pm2_5 > 20")
def s15(spark, sf):
    name = scratch_path(spark, "view").rsplit("/", 1)[1].replace("-", "_")
    view = tables.register_view(panel_hourly(spark, sf), name, ["station", "time", "pm2_5"])
    return view.filter("pm2_5 > 20")


@query(
    "s16_table_summary",
    f"WITH {READINGS} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null, count(*) AS rows,
min(time) AS first_time, max(time) AS last_time FROM readings"""
        for c, t in [("station", "string"), ("seq", "bigint"), *[(m, "double") for m in MEASURES]]
    ),
)
def s16(spark, sf):
    return tables.table_summary(readings(spark, sf).select("station", "time", "seq", *MEASURES))


@query(
    "s16b_first_last",
    f"""WITH {READINGS}, r AS (SELECT station, seq, time, pm2_5, row_number() OVER (ORDER BY time, seq) AS i, count(*) OVER () AS n FROM readings)
SELECT CASE WHEN i <= 10 THEN 'first' ELSE 'last' END AS part, station, seq, time, pm2_5 FROM r WHERE i <= 10 OR i > n - 10""",
)
def s16b(spark, sf):
    found = tables.table_report(readings(spark, sf).select("station", "seq", "time", "pm2_5"), 10, order=["seq"])
    return found.first.withColumn("part", F.lit("first")).unionByName(found.last.withColumn("part", F.lit("last")))


@query(
    "s16c_statistics",
    f"WITH {READINGS} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", avg({c}) AS mean, stddev_samp({c}) AS std, min({c}::DOUBLE) AS "min", max({c}::DOUBLE) AS "max",
quantile_cont({c}::DOUBLE, 0.25) AS q25, quantile_cont({c}::DOUBLE, 0.5) AS q50, quantile_cont({c}::DOUBLE, 0.75) AS q75 FROM readings"""
        for c in ("seq", "pm2_5", "ozone")
    ),
    dbl="mean std min max q25 q50 q75",
)
def s16c(spark, sf):
    return tables.table_report(readings(spark, sf).select("station", "time", "seq", "pm2_5", "ozone")).statistics


@query(
    "s17_save_load_params",
    f"WITH {READINGS} "
    + " UNION ALL ".join(
        f"SELECT station, 'pm' AS grp, '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS scale FROM readings GROUP BY station"
        for c in ("pm2_5", "pm10")
    ),
    dbl="mean scale",
)
def s17(spark, sf):
    path = scratch_path(spark, "params")
    store.save_params(fit_scaler(readings(spark, sf), {"pm": ["pm2_5", "pm10"]}), path)
    return store.load_params(spark, path)


@query(
    "s18_latest_version",
    f"""WITH {READINGS} SELECT station AS name, max(CAST(pressure AS INTEGER) - 1000) AS version,
concat(station, '/v', max(CAST(pressure AS INTEGER) - 1000)) AS path FROM readings GROUP BY station""",
)
def s18(spark, sf):
    v = (F.col("pressure").cast("int") - 1000).cast("string")
    manifest = readings(spark, sf).select(
        F.col("station").alias("name"), v.alias("version"), F.concat("station", F.lit("/v"), v).alias("path")
    )
    return store.latest_version(manifest)
