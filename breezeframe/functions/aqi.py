"""Air-quality index expressions. Three published variants differ and stay apart."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breezeframe.schema import (
    AQI_CATEGORIES,
    BREAKPOINTS,
    CO_PPM_PER_UG,
    MERGED_TOP_BAND,
    OZONE_PPB_PER_UG,
)

Band = tuple[float, float, int, int]


def _index(c: Column, band: Band) -> Column:
    """Linear index inside one band, halves to even."""
    c_lo, c_hi, i_lo, i_hi = band
    slope = F.lit(float(i_hi - i_lo) / (c_hi - c_lo))
    return F.bround(slope * (c - F.lit(c_lo)) + F.lit(float(i_lo))).cast("int")


def _first_match(tests: Iterable[tuple[Column, Column]]) -> Column:
    tests = iter(tests)
    cond, value = next(tests)
    chain = F.when(cond, value)
    for cond, value in tests:
        chain = chain.when(cond, value)
    return chain


def aqi_strict(c: Column, pollutant: str) -> Column:
    """Index where a band holds the value; null between bands, outside the table, or for null."""
    return _first_match(
        (c.between(F.lit(b[0]), F.lit(b[1])), _index(c, b)) for b in BREAKPOINTS[pollutant]
    )


def aqi_clamped(c: Column, pollutant: str, nonfinite_as_zero: bool = False) -> Column:
    """Round to the table's step, clamp at zero, close the gaps between bands, 500 above."""
    if nonfinite_as_zero:
        bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
        c = F.when(bad, F.lit(0.0)).otherwise(c)
    c = F.bround(c * 10) / 10 if pollutant == "pm2_5" else F.bround(c)
    c = F.when(c < 0, F.lit(0.0)).otherwise(c)
    bands = _first_match((c <= F.lit(b[1]), _index(c, b)) for b in BREAKPOINTS[pollutant])
    return F.when(c.isNotNull(), F.coalesce(bands, F.lit(500)))


def aqi_analysis(c: Column, pollutant: str) -> Column:
    """Zero for null, negative and unmatched values; merged top band for CO, NO2 and SO2."""
    bands = list(BREAKPOINTS[pollutant])
    if pollutant in MERGED_TOP_BAND:
        bands = bands[:-2] + [MERGED_TOP_BAND[pollutant]]
    if pollutant == "o3_8h":
        c = c * OZONE_PPB_PER_UG
    elif pollutant == "co":
        c = c * CO_PPM_PER_UG
    found = _first_match((c.between(F.lit(b[0]), F.lit(b[1])), _index(c, b)) for b in bands)
    return F.coalesce(found, F.lit(0))


def us_aqi(*parts: Column) -> Column:
    """Largest part; null as soon as one part is null."""
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known = known & p.isNotNull()
    return F.when(known, F.greatest(*parts))


def controlling_pollutant(columns: Sequence[str], suffix: str = "_individual_aqi") -> Column:
    """Name of the largest column, the first one on ties, without its suffix."""
    values = F.array(*[F.coalesce(F.col(c), F.lit(0)) for c in columns])
    names = F.array(*[F.lit(c.removesuffix(suffix)) for c in columns])
    return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))


def _by_category(aqi: Column, field: int) -> Column:
    *inner, last = AQI_CATEGORIES
    chain = _first_match((aqi <= cat[2], F.lit(cat[field])) for cat in inner)
    return F.when(aqi.isNotNull(), F.coalesce(chain, F.lit(last[field])))


def aqi_category(aqi: Column) -> Column:
    return _by_category(aqi, 0)


def aqi_colour(aqi: Column) -> Column:
    return _by_category(aqi, 3)


def abs_deviation(own: Column, monitor: Column) -> Column:
    return F.abs(own - monitor)


def with_aqi(df: DataFrame) -> DataFrame:
    """PM2.5, PM10 and combined index."""
    pm25, pm10 = aqi_strict(F.col("pm2_5"), "pm2_5"), aqi_strict(F.col("pm10"), "pm10")
    return df.withColumns({"pm2_5_aqi": pm25, "pm10_aqi": pm10}).withColumn(
        "us_aqi", us_aqi(F.col("pm2_5_aqi"), F.col("pm10_aqi"))
    )


def breakpoint_table(spark: SparkSession) -> DataFrame:
    rows = [(p, *band) for p, bands in BREAKPOINTS.items() for band in bands]
    return spark.createDataFrame(
        rows, "pollutant string, c_lo double, c_hi double, i_lo int, i_hi int"
    )


def category_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AQI_CATEGORIES, "name string, min int, max int, color string")


def aqi_lookup(df: DataFrame, column: str, pollutant: str, out: str, table: DataFrame) -> DataFrame:
    """Index from a rule *table* instead of folded rules.

    The table is the published one, at most a few dozen rows, hence the broadcast.
    """
    rules = F.broadcast(table.filter(F.col("pollutant") == pollutant).drop("pollutant"))
    c = F.col(column)
    value = F.bround(
        (F.col("i_hi") - F.col("i_lo")) / (F.col("c_hi") - F.col("c_lo")) * (c - F.col("c_lo"))
        + F.col("i_lo")
    ).cast("int")
    joined = df.join(rules, c.between(F.col("c_lo"), F.col("c_hi")), "left")
    return joined.withColumn(out, value).drop("c_lo", "c_hi", "i_lo", "i_hi")


def _index_sql(pollutant: str, c: str) -> str:
    whens = " ".join(
        f"WHEN {c} BETWEEN {lo}D AND {hi}D THEN "
        f"CAST(bround({float(i_hi - i_lo) / (hi - lo)!r}D * ({c} - {lo}D) + {float(i_lo)}D) AS INT)"
        for lo, hi, i_lo, i_hi in BREAKPOINTS[pollutant]
    )
    return f"CASE {whens} END"


def _category_sql(i: str) -> str:
    cats = " ".join(f"WHEN {i} <= {hi} THEN '{name}'" for name, _, hi, _ in AQI_CATEGORIES[:-1])
    return f"CASE WHEN {i} IS NULL THEN NULL {cats} ELSE '{AQI_CATEGORIES[-1][0]}' END"


def register_sql_functions(spark: SparkSession) -> list[str]:
    """``aqi_pm25(c)``, ``aqi_pm10(c)`` and ``aqi_category(i)`` as inlined SQL functions."""
    bodies = {
        "aqi_pm25(c DOUBLE) RETURNS INT": _index_sql("pm2_5", "c"),
        "aqi_pm10(c DOUBLE) RETURNS INT": _index_sql("pm10", "c"),
        "aqi_category(i INT) RETURNS STRING": _category_sql("i"),
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in bodies]


def register_sql_tables(spark: SparkSession, view: str) -> list[str]:
    """Table functions over a view of readings, beside the scalar ones: ``<view>_hours(since,
    until)`` with the hourly means and their index, and ``<view>_exceedances(least, since, until)``
    with the days on which the index reached ``least``. Catalyst inlines both, so their bounds and
    whatever a query adds reach the scan."""
    register_sql_functions(spark)
    hours = f"""
        SELECT station, hour, pm2_5, pm10, us_aqi, {_category_sql('us_aqi')} AS category FROM (
          SELECT station, hour, pm2_5, pm10,
            CASE WHEN a25 IS NOT NULL AND a10 IS NOT NULL THEN greatest(a25, a10) END AS us_aqi
          FROM (SELECT station, hour, pm2_5, pm10, {_index_sql('pm2_5', 'pm2_5')} AS a25, {_index_sql('pm10', 'pm10')} AS a10
            FROM (SELECT station, date_trunc('hour', time) AS hour, avg(pm2_5) AS pm2_5, avg(pm10) AS pm10
              FROM {view} WHERE time >= since AND time < until GROUP BY station, date_trunc('hour', time))))"""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {view}_hours(since TIMESTAMP, until TIMESTAMP)
        RETURNS TABLE (station STRING, hour TIMESTAMP, pm2_5 DOUBLE, pm10 DOUBLE, us_aqi INT, category STRING)
        RETURN {hours}""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {view}_exceedances(least INT, since TIMESTAMP, until TIMESTAMP)
        RETURNS TABLE (station STRING, day DATE, hours BIGINT, worst INT)
        RETURN SELECT station, to_date(hour), count(*), max(us_aqi) FROM ({hours})
          WHERE us_aqi >= least GROUP BY station, to_date(hour)""")
    return [f"{view}_hours", f"{view}_exceedances"]
