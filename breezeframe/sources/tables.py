"""Scans, point lookups, views and summaries of stored tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from breezeframe.functions.features import hour_keys, time_key
from breezeframe.operators.aggregates import describe
from breezeframe.schema import KEYS, TIME
from breezeframe.session import materialise
from breezeframe.sources.store import is_missing, is_table, read_table


def read_csv_series(spark: SparkSession, path: str, schema: T.StructType, time: str = TIME) -> DataFrame:
    """CSV with a declared schema; unparsable times become null. Order at the sink."""
    as_text = T.StructType(
        [T.StructField(f.name, T.StringType()) if f.name == time else f for f in schema]
    )
    raw = spark.read.schema(as_text).option("header", True).csv(path)
    return raw.withColumn(time, F.try_to_timestamp(F.col(time)))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_features(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Stored table without its key string and without rows lacking a time.

    ``path`` is a plain Parquet folder or a keyed table. A missing table reads as an empty one
    when ``schema`` says what it would hold.
    """
    try:
        df = read_table(spark, path) if is_table(spark, path) else spark.read.parquet(path)
    except AnalysisException as e:
        if schema is None or not is_missing(e):
            raise
        df = spark.createDataFrame([], schema)
    if TIME in df.columns:
        df = df.withColumn(TIME, F.col(TIME).cast("timestamp")).filter(F.col(TIME).isNotNull())
    return df.drop("time_str")


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fail at planning time when a needed column is absent."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_rows(
    df: DataFrame, expected: int | str, by: Sequence[str] = KEYS, known: DataFrame | None = None
) -> DataFrame:
    """Row count per key against an expected number or column; a mismatch fails the job.

    The counts are one row per key; they join back only to carry the check along. ``known``
    names the keys that must be there: one without any row fails too.
    """
    want = F.lit(expected) if isinstance(expected, int) else F.max(expected)
    n = F.count(F.lit(1))
    checked = df.groupBy(*by).agg(n.alias("_n"), want.alias("_want"))
    if known is not None:
        checked = known.select(*by).distinct().join(checked, list(by), "left").fillna(0, ["_n"])
        if isinstance(expected, int):
            checked = checked.withColumn("_want", F.lit(expected))
    verdict = F.when(F.col("_n") == F.col("_want"), F.lit(True)).otherwise(
        F.raise_error(F.concat_ws(" ", F.lit("rows:"), "_n", F.lit("expected:"), "_want"))
    )
    if known is None:
        return df.join(checked.filter(verdict).select(*by), list(by))
    # the keys are the preserved side: an absent one is seen even when ``df`` is empty
    return checked.join(df, list(by), "left").filter(verdict).select(*df.columns)


def lookup_hours(
    df: DataFrame,
    anchors: DataFrame,
    n: int,
    forward: bool,
    anchor: str = "anchor",
    keys: Sequence[str] = KEYS,
    strict: bool = True,
) -> DataFrame:
    """The ``n`` hourly rows after or up to each anchor, found by key string.

    ``strict`` fails the job for a station that does not have every requested hour exactly
    once: a doubled hour would give more than ``n`` rows.
    """
    wanted = hour_keys(anchors.select(*keys, anchor), anchor, n, forward).select(
        *keys, "time_str", "key_time"
    )
    keyed = df if "time_str" in df.columns else df.withColumn("time_str", time_key())
    if not strict:
        return wanted.join(keyed, [*keys, "time_str"])
    same = Window.partitionBy(*keys, "time_str")
    asked = keyed.join(wanted.select(*keys, "time_str").distinct(), [*keys, "time_str"], "left_semi")
    counted = asked.withColumn("_hit", F.count(F.lit(1)).over(same))
    found = wanted.join(counted, [*keys, "time_str"], "left")
    present = F.when(F.col("_hit") == 1, F.lit(True)).otherwise(
        F.raise_error(F.concat(
            F.when(F.col("_hit") > 1, "several rows for hour ").otherwise("no row for hour "), F.col("time_str")
        ))
    )
    return found.filter(present).drop("_hit")


def time_chunks(df: DataFrame, start: str, end: str, hours: int = 24) -> DataFrame:
    """Consecutive sub-ranges of ``[start, end)``, the last one possibly shorter."""
    step = F.expr(f"interval {hours} hours")
    begins = F.filter(
        F.sequence(F.col(start), F.col(end), step), lambda t: t < F.col(end)
    )
    return (
        df.withColumn("chunk_start", F.explode(begins))
        .withColumn("chunk_end", F.least(F.col("chunk_start") + step, F.col(end)))
    )


class ChunkRead(NamedTuple):
    """Rows of the chunks that could be read, and the chunks that could not, with the reason."""

    rows: DataFrame
    failed: DataFrame


def broken_files(spark: SparkSession, path: str, part: str = "date") -> DataFrame:
    """``path, <part>, error`` of the Parquet files below a partitioned folder that cannot be
    opened. Each task opens its share by the file system of the path; footers only, so a file whose
    pages are damaged behind a sound footer still fails the job that reads it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", part)

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs, parquet

        for batch in batches:
            errors = []
            for name in batch.column(0).to_pylist():
                name = "/" + name[5:].lstrip("/") if name.startswith("file:") else name
                try:
                    store, place = (fs.LocalFileSystem(), name) if name.startswith("/") else fs.FileSystem.from_uri(name)
                    with store.open_input_file(place) as f:
                        parquet.read_metadata(f)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(errors, pa.string())], [*batch.schema.names, "error"])

    kind = files.schema[part].dataType.simpleString()
    return files.mapInArrow(run, f"path string, {part} {kind}, error string").where("error IS NOT NULL")


def read_chunks(
    spark: SparkSession, path: str, chunks: DataFrame, part: str = "date", keys: Sequence[str] = KEYS, time: str = TIME
) -> ChunkRead:
    """The rows of :func:`time_chunks` from a folder partitioned by day, chunk by chunk.

    A chunk with a day that has a broken file is skipped and listed; the others are read whole.
    The days that are wanted reach the scan as a dynamic partition filter, so neither other days nor
    broken ones are opened. Chunks are few beside rows: one row per key and day or so.
    """
    spans = chunks.withColumn("_days", F.sequence(
        F.to_date("chunk_start"), F.to_date(F.col("chunk_end") - F.expr("interval 1 microsecond")), F.expr("interval 1 day")
    ))
    days = spans.select(*keys, "chunk_start", "chunk_end", F.explode("_days").alias("_day"))
    bad = broken_files(spark, path, part).groupBy(F.to_date(part).alias("_day")).agg(F.min("error").alias("error"))
    marked = materialise(
        days.join(bad, "_day", "left").groupBy(*keys, "chunk_start", "chunk_end").agg(
            F.min("error").alias("error"), F.count("error").alias("broken"), F.collect_set("_day").alias("_days")
        ), "chunks",
    )
    good = marked.where("broken = 0").select(*keys, "chunk_start", "chunk_end", F.explode("_days").alias("_day"))
    rows = spark.read.parquet(path).withColumn("_at", F.to_date(part))
    wanted = good.select("_day").distinct().where("_day > DATE'0001-01-01'")
    kept = rows.join(F.broadcast(wanted), F.col(part) == F.col("_day")).drop("_day")
    inside = [kept[k] == good[k] for k in keys] + [kept["_at"] == good["_day"], kept[time] >= good["chunk_start"], kept[time] < good["chunk_end"]]
    condition = inside[0]
    for c in inside[1:]:
        condition = condition & c
    found = kept.join(good, condition).select(*[kept[c] for c in rows.columns if c != "_at"], "chunk_start", "chunk_end")
    return ChunkRead(found, marked.where("broken > 0").select(*keys, "chunk_start", "chunk_end", "error"))


def register_view(df: DataFrame, name: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Get or create a named view over all or some columns."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        (df.select(*cols) if cols else df).createOrReplaceTempView(name)
    return spark.table(name)


def table_summary(df: DataFrame, time: str = TIME) -> DataFrame:
    """One row per column: type, non-null rows, table rows and time range."""
    cols = [c for c in df.columns if c != time]
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        *[F.count(c).alias(f"n_{c}") for c in cols],
    )
    types = dict(df.dtypes)
    per_col = F.explode(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.col(f"n_{c}").alias("non_null")
        )
        for c in cols
    ]))
    return one.select("rows", "first_time", "last_time", per_col.alias("c")).select(
        "c.*", "rows", "first_time", "last_time"
    )


class TableReport(NamedTuple):
    """What :func:`table_report` gives; nothing is computed before a part is read."""

    summary: DataFrame
    statistics: DataFrame
    first: DataFrame
    last: DataFrame


def table_report(df: DataFrame, n: int = 10, time: str = TIME, order: Sequence[str] = ()) -> TableReport:
    """A stored table at a glance: summary per column, statistics of the numeric columns over the
    whole table (exact quartiles), and its first and last ``n`` rows in time, then by ``order``.
    Each task keeps ``n`` rows of its own before they meet."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    first = df.orderBy(time, *order).limit(n)
    last = df.orderBy(F.desc(time), *[F.desc(c) for c in order]).limit(n)
    return TableReport(table_summary(df, time), describe(df, numeric, ()), first, last.orderBy(time, *order))
