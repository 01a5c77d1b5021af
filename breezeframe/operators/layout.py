"""How long series are cut into pieces a cluster can spread.

A window partitioned by station alone puts a whole station on one task, however many
rows that station holds. Every window operator here therefore works on *pieces* of a
series: ``halo`` cuts a series at fixed widths on an integer axis (microseconds or row
position) and copies to each piece the rows its windows look back at or ahead to;
``core`` drops those copies again. Operators without a bounded reach (fill, row number)
work on pieces plus one small carry row per piece, see ``carried`` and
``with_position``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from breezeframe.schema import KEYS, SEQ, TIME

US_PER_HOUR = 3_600_000_000
CHUNK_HOURS = 168
CARRY_BUCKET_HOURS = 6
POSITION_WIDTH = 50_000
#: rows, copies included, that one task of a shuffle is meant to sort
TASK_ROWS = 300_000

PIECE = "_piece"
CORE = "_core"
US = "_us"


def micros(time: str | Column = TIME) -> Column:
    """Microseconds since the epoch: exact, and usable in RANGE frames."""
    return F.unix_micros(F.col(time) if isinstance(time, str) else time)


def floor_div(axis: Column, width: int) -> Column:
    """Integer floor division, exact for 64-bit values and negative ones."""
    w = F.lit(width).cast("bigint")
    return F.call_function("div", axis - F.pmod(axis, w), w)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks to deal so many rows to: one for each ``TASK_ROWS``, and no idle cores."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))


def halo(
    df: DataFrame, axis: Column, back: int, ahead: int = 0, width: int = CHUNK_HOURS * US_PER_HOUR
) -> DataFrame:
    """Cut on ``axis`` and copy each row to every piece that can see it.

    A row is copied about ``1 + (back + ahead) / width`` times, so ``width`` should be
    a few times the reach.
    """
    home = floor_div(axis, width)
    if back == 0 and ahead == 0:
        return df.withColumn(PIECE, home).withColumn(CORE, F.lit(True))
    pieces = F.sequence(floor_div(axis - F.lit(ahead), width), floor_div(axis + F.lit(back), width))
    return (
        df.withColumn("_home", home)
        .withColumn(PIECE, F.explode(pieces))
        .withColumn(CORE, F.col(PIECE) == F.col("_home"))
        .drop("_home")
    )


def time_halo(
    df: DataFrame,
    back_hours: float,
    ahead_hours: float = 0,
    chunk_hours: float = CHUNK_HOURS,
    time: str = TIME,
) -> DataFrame:
    """``halo`` on the time axis; leaves the microsecond column ``_us`` in place."""
    return halo(
        df.withColumn(US, micros(time)),
        F.col(US),
        round(back_hours * US_PER_HOUR),
        round(ahead_hours * US_PER_HOUR),
        round(chunk_hours * US_PER_HOUR),
    )


def core(df: DataFrame) -> DataFrame:
    """Drop halo copies and the helper columns."""
    return df.filter(F.col(CORE)).drop(PIECE, CORE, US, "_nus")


def piece_window(keys: Sequence[str] = KEYS) -> Window:
    return Window.partitionBy(*keys, PIECE)


def pick_chunk_hours(
    df: DataFrame,
    reach_hours: float,
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    target_rows: int = 5_000_000,
) -> float:
    """Width at which the densest station-day fills one piece with ``target_rows`` rows.

    One aggregate over key and time columns; a single number comes back. Never narrower
    than half the reach, so no row is copied more than three times.
    """
    day = floor_div(micros(time), 24 * US_PER_HOUR)
    densest = (
        df.groupBy(*keys, day.alias("_d")).count().agg(F.max("count").alias("n")).first()["n"] or 1
    )
    hours = 24.0 * target_rows / densest
    return float(min(max(hours, reach_hours / 2, 1.0), 24.0 * 365))


def carried(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = KEYS,
    ahead: bool = False,
    bucket_hours: float = CARRY_BUCKET_HOURS,
    time: str = TIME,
    seq: str = SEQ,
) -> DataFrame:
    """Add ``_prev_<col>``, the last non-null value strictly before each row, and with
    ``ahead`` also ``_next_<col>``, the first one strictly after it.

    Inside a bucket a running frame finds it. What reaches in from other buckets comes
    from a carry table with one row per station and bucket, which is the only thing ever
    ordered over a whole station. The rows are counted when this is called, and dealt out by
    bucket to tasks of a bounded size before anything is sorted.
    """
    cols = list(cols)
    sides = {"_prev_": False, "_next_": True} if ahead else {"_prev_": False}
    tasks = tasks_for(df.sparkSession, df.count() * len(sides))  # a row is sorted once a side
    bucket = floor_div(micros(time), round(bucket_hours * US_PER_HOUR))
    bucketed = df.withColumn("_bucket", bucket).repartition(tasks, *keys, "_bucket")
    place = F.struct(time, seq)
    edges, carries, nears = [], [], []
    for side, backward in sides.items():
        edge = F.min_by if backward else F.max_by
        up = (lambda c: F.col(c).desc()) if backward else F.col
        across = Window.partitionBy(*keys).orderBy(up("_bucket"))
        local = Window.partitionBy(*keys, "_bucket").orderBy(up(time), up(seq))
        for c in cols:
            at = F.when(F.col(c).isNotNull(), place)
            edges.append(edge(F.col(c), at).alias(f"_edge{side}{c}"))
            before = across.rowsBetween(Window.unboundedPreceding, -1)
            carries.append(F.last(f"_edge{side}{c}", ignorenulls=True).over(before).alias(f"_carry{side}{c}"))
            before = local.rowsBetween(Window.unboundedPreceding, -1)
            nears.append(F.last(c, ignorenulls=True).over(before).alias(f"_near{side}{c}"))
    carry = bucketed.groupBy(*keys, "_bucket").agg(*edges).select(*keys, "_bucket", *carries)
    joined = bucketed.select("*", *nears).join(carry, [*keys, "_bucket"], "left")
    return joined.select(
        *df.columns,
        *[F.coalesce(f"_near{s}{c}", f"_carry{s}{c}").alias(f"{s}{c}") for s in sides for c in cols],
    )


def with_position(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    pos: str = "pos",
    total: str | None = None,
    bucket_hours: float = CARRY_BUCKET_HOURS,
    time: str = TIME,
    seq: str | None = SEQ,
) -> DataFrame:
    """1-based row position per station in time order, and the station's row count.

    Numbered inside time buckets, then shifted by the counts of the earlier buckets.
    """
    bucket = floor_div(micros(time), round(bucket_hours * US_PER_HOUR))
    order = [time] if seq is None else [time, seq]
    counts = df.groupBy(*keys, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    offsets = counts.select(
        *keys,
        "_bucket",
        F.coalesce(
            F.sum("_n").over(
                whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_before"),
        F.sum("_n").over(whole).alias("_total"),
    )
    numbered = df.withColumn("_bucket", bucket).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    )
    out = numbered.join(offsets, [*keys, "_bucket"])
    extra = [F.col("_total").alias(total)] if total else []
    return out.select(*df.columns, (F.col("_before") + F.col("_rn")).alias(pos), *extra)


def position_halo(
    df: DataFrame, back: int, ahead: int = 0, pos: str = "pos", width: int = POSITION_WIDTH
) -> DataFrame:
    """``halo`` on row positions: pieces of equal size whatever the station's density."""
    return halo(df, F.col(pos), back, ahead, width)
