"""Structured Streaming jobs over payload documents and hourly rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from breezeframe.functions.aqi import aqi_category, with_aqi
from breezeframe.operators.shaping import normalise_names
from breezeframe.operators.windows import Change, Lag, Rolling, reach_of, window_features
from breezeframe.schema import AQI_CATEGORIES, KEYS, POLLUTANT_NAMES, TIME
from breezeframe.session import staged
from breezeframe.sources.payloads import COMPONENTS, component_names, entries, widened
from breezeframe.sources.store import DAY, read_table, upsert_features, upsert_rows

_COUNTS = [(name, "n_" + name.lower().replace(" ", "_")) for name, *_ in AQI_CATEGORIES]


def read_documents(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of ``(station, payload)`` documents from a folder of Parquet files."""
    reader: DataStreamReader = spark.readStream.schema("station string, payload string")
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(path)


def hourly_ingest(
    path: str, rejects: str | None = None, keys: Sequence[str] = KEYS
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` handler: flatten the documents and upsert one row per station and hour.

    The table keeps what has arrived, so no delivery is too late and a replay changes
    nothing; of an hour's rows the last one wins, later deliveries before earlier ones. Each
    document is parsed once. A component that was never seen before becomes a new column of the
    table (``component_`` before a name that is taken). What cannot be used is kept in the
    folder ``rejects``, with its reason, under the batch's number: a batch that runs again
    replaces its own rejects. Without that folder a document that cannot be used is an error.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        with staged(entries(batch), "ingest") as parsed:
            refused = parsed.where("reason IS NOT NULL")
            if rejects:
                kept = refused.select(*keys, "payload", "reason")
                kept.write.mode("overwrite").parquet(f"{rejects}/epoch={epoch}")
            elif not refused.isEmpty():
                raise ValueError("documents that cannot be used, and no folder for them")
            taken = {c.lower() for c in (*batch.columns, TIME, "time_str", DAY, "openweather_aqi", *POLLUTANT_NAMES.values())}
            names = {c: c for c in COMPONENTS}
            for c in component_names(parsed):
                if c not in names:
                    names[c] = f"component_{c}" if c.lower() in taken else c
                    taken.add(names[c].lower())
            upsert_features(normalise_names(widened(parsed, names)), path, [*keys, "time_str"])

    return handle


def rejected(spark: SparkSession, rejects: str) -> DataFrame:
    """Everything :func:`hourly_ingest` could not use; a document delivered twice is there twice."""
    return spark.read.parquet(rejects)


def bucket_stats(
    rows: DataFrame, bucket: str = "1 hour", watermark: str = "26 hours", keys: Sequence[str] = KEYS
) -> DataFrame:
    """PM sums and index category counts per bucket, the level below :func:`sliding_windows`.

    One state row per key and bucket, dropped once the watermark has passed the bucket: with the
    default a row may be a day and two hours late, and the state holds 27 buckets a key.
    """
    scored = with_aqi(rows).withColumn("_cat", aqi_category(F.col("us_aqi")))
    counts = [F.count(F.when(F.col("_cat") == name, 1)).alias(column) for name, column in _COUNTS]
    stats = [
        F.sum("pm2_5").alias("pm2_5_sum"), F.min("pm2_5").alias("pm2_5_min"),
        F.max("pm2_5").alias("pm2_5_max"), F.count("pm2_5").alias("n"), F.count(F.lit(1)).alias("rows"),
    ]
    found = scored.withWatermark(TIME, watermark).groupBy(F.window(TIME, bucket), *keys).agg(*stats, *counts)
    return found.select(*keys, F.col("window.start").alias("bucket"), *[c for c in found.columns if c not in ("window", *keys)])


def sliding_windows(buckets: DataFrame, seconds: int = 3600, per_window: int = 24, keys: Sequence[str] = KEYS) -> DataFrame:
    """Statistics of every window of ``per_window`` buckets that holds a row, from bucket sums.

    A row reaches its windows through its bucket only: windows are laid out where buckets are (a
    grid over groups of ``per_window`` buckets), and a range frame adds a window's buckets up. The
    series is cut into pieces of 32 windows that share their edges, so no series is one task.
    """
    whole = [*keys, "_at"]
    at = (F.unix_seconds("bucket") / seconds).cast("bigint")
    data = buckets.withColumn("_at", at).drop("bucket").withColumn("_window", F.lit(False))
    groups = data.select(*keys, F.floor(F.col("_at") / per_window).alias("_g")).distinct()
    groups = groups.select(*keys, F.explode(F.array(F.col("_g"), F.col("_g") - 1)).alias("_g")).distinct()
    steps = F.sequence(F.lit(0), F.lit(per_window - 1))
    grid = groups.select(*keys, F.explode(F.transform(steps, lambda i: F.col("_g") * per_window + i)).alias("_at"))
    both = data.unionByName(grid.withColumn("_window", F.lit(True)), allowMissingColumns=True)

    piece = 32 * per_window
    own = F.floor(F.col("_at") / piece)
    shared = ~F.col("_window") & (F.pmod("_at", F.lit(piece)) < per_window - 1)
    cut = both.withColumn("_piece", F.explode(F.when(shared, F.array(own, own - 1)).otherwise(F.array(own))))
    frame = Window.partitionBy(*keys, "_piece").orderBy("_at").rangeBetween(0, per_window - 1)
    sums = [c for c in data.columns if c not in (*whole, "_window", "pm2_5_min", "pm2_5_max")]
    totals = [F.sum(c).over(frame).alias(c) for c in sums]
    found = cut.select(
        *whole, "_window", *totals, F.min("pm2_5_min").over(frame).alias("pm2_5_min"), F.max("pm2_5_max").over(frame).alias("pm2_5_max")
    ).where("_window AND rows > 0")
    start, width = F.timestamp_seconds(F.col("_at") * seconds), F.make_dt_interval(secs=F.lit(seconds * per_window))
    mean = F.when(F.col("n") > 0, F.col("pm2_5_sum") / F.col("n")).alias("pm2_5_mean")
    return found.select(
        *keys, start.alias("window_start"), (start + width).alias("window_end"), mean, "pm2_5_min", "pm2_5_max",
        *[c for c in sums if c not in ("pm2_5_sum", "rows")],
    )


def keep_windows(
    bucket_path: str, window_path: str, seconds: int = 3600, per_window: int = 24, keys: Sequence[str] = KEYS
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` handler for :func:`bucket_stats` in update mode: stores the buckets that
    changed and the windows that hold one of them, also those that the watermark has not closed
    yet. What is read and written follows from the time range of the changed buckets."""
    reach = timedelta(seconds=seconds * (per_window - 1))

    def handle(batch: DataFrame, epoch: int) -> None:
        span = F.min("bucket").alias("lo"), F.max("bucket").alias("hi")
        with staged(batch, "buckets") as changed:
            lo, hi = changed.agg(*span).first()
            if lo is None:
                return
            upsert_rows(changed.withColumn(DAY, F.to_date("bucket")), bucket_path, DAY, [*keys, "bucket"], ["bucket"])
        day = timedelta(days=1)  # the bounds arrive in the driver's zone
        near = read_table(batch.sparkSession, bucket_path, (lo - reach - day).date(), (hi + reach + day).date())
        near = near.drop(DAY).where(F.col("bucket").between(lo - reach, hi + reach))
        fresh = sliding_windows(near, seconds, per_window, keys).where(F.col("window_start").between(lo - reach, hi))
        upsert_rows(fresh.withColumn(DAY, F.to_date("window_start")), window_path, DAY, [*keys, "window_start"], ["window_start"])

    return handle


def run_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, append to a Parquet folder and stop."""
    query = (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def feature_updates(
    raw_path: str,
    feature_path: str,
    lags: Sequence[Lag] = (),
    rolls: Sequence[Rolling] = (),
    changes: Sequence[Change] = (),
    columns: Sequence[str] = ("pm2_5", "pm10"),
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` handler: store the batch, then recompute the rows it can affect.

    How far a row reaches follows from the features asked for: it changes those of rows up to
    the longest lag or window later, and those look back as far again, so only the days
    within that reach are read. Both writes are keyed upserts: a batch that is replayed after
    a failure changes nothing.
    """
    back, ahead = (timedelta(hours=h) for h in reach_of(lags, rolls, changes))
    names = [s.name for s in [*lags, *rolls, *changes]]

    def handle(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        upsert_features(batch, raw_path)
        # three bounds, one row
        span = batch.agg(F.min(TIME).alias("lo"), F.max(TIME).alias("hi"))
        lo, hi = span.select("lo", "hi").first()
        first, last = lo - ahead - back, hi + back + ahead
        day = timedelta(days=1)  # the bounds arrive in the driver's zone
        raw = read_table(spark, raw_path, first.date() - day, last.date() + day)
        raw = raw.filter(F.col(TIME).between(first, last))
        fresh = window_features(raw.withColumn("seq", F.unix_seconds(TIME)), lags, rolls, changes)
        touched = fresh.filter(F.col(TIME).between(lo - ahead, hi + back)).select(*KEYS, TIME, *columns, *names)
        upsert_features(touched, feature_path)

    return handle


def run_updates(
    rows: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    query = (
        rows.writeStream.foreachBatch(handler).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
