"""Flatten nested service payloads into flat rows.

Every function takes a frame with a JSON string column; other columns (the station, an
ingest id) pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeframe.schema import MONITOR_PAYLOAD, POLLUTANT_NAMES, POLLUTION_PAYLOAD, WEATHER_ITEM, WEATHER_PAYLOAD
from breezeframe.session import materialise

COMPONENTS = ["co", "no", "no2", "o3", "so2", "pm2_5", "pm10", "nh3"]


def _items(df: DataFrame, payload: str, schema, ordered: bool = False) -> DataFrame:
    parsed = df.withColumn("_p", F.from_json(payload, schema)).drop(payload)
    rest = [c for c in parsed.columns if c != "_p"]
    if ordered:
        return parsed.select(*rest, F.posexplode("_p.list").alias("_pos", "_item"))
    return parsed.select(*rest, F.explode("_p.list").alias("_item"))


def _at() -> Column:
    return F.timestamp_seconds("_item.dt").alias("time")


def _component(name: str) -> Column:
    return F.try_element_at("_item.components", F.lit(name))


def _weather(units: str = "metric") -> list[Column]:
    temp = F.col("_item.main.temp")
    if units == "kelvin":
        temp = temp - 273.15
    return [
        temp.alias("temperature"),
        F.col("_item.main.humidity").alias("humidity"),
        F.col("_item.main.pressure").alias("pressure"),
        F.col("_item.wind.speed").alias("wind_speed"),
        F.col("_item.wind.deg").alias("wind_direction"),
    ]


def entries(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The pollution documents in one parse: a row per list entry with ``time``,
    ``openweather_aqi`` and the map ``components``, whatever its keys, and a row with a
    ``reason`` for what cannot be used: ``malformed`` (no JSON), ``no list``, ``no time``. Such
    rows keep their payload, the others have null there. An empty list gives no row, a value
    that is no number is null under its key.
    """
    rest = [c for c in df.columns if c != payload]
    parsed = df.withColumn("_doc", F.try_parse_json(payload))
    listed = parsed.withColumn("_list", F.try_variant_get("_doc", "$.list", "array<variant>"))
    held = F.when(F.col("_list").isNotNull(), F.col("_list")).otherwise(F.array(F.lit(None).cast("variant")))
    each = listed.select(*rest, payload, "_doc", F.col("_list").isNull().alias("_bad"), F.explode(held).alias("_e"))
    dt = F.try_variant_get("_e", "$.dt", "bigint")
    reason = (
        F.when(F.col("_doc").isNull(), "malformed").when(F.col("_bad"), "no list").when(dt.isNull(), "no time")
    )
    found = F.try_variant_get("_e", "$.components", "map<string,variant>")
    numbers = F.transform_values(found, lambda k, v: F.try_variant_get(v, "$", "double"))
    return each.select(
        *rest,
        F.timestamp_seconds(dt).alias("time"),
        F.try_variant_get("_e", "$.main.aqi", "int").alias("openweather_aqi"),
        numbers.alias("components"),
        reason.alias("reason"),
        F.when(reason.isNotNull(), F.col(payload)).alias(payload),
    )


def rejected_documents(df: DataFrame, payload: str = "payload") -> DataFrame:
    """What flattening cannot use, with the ``reason``; an entry without time gives its document."""
    kept = [c for c in df.columns if c != payload]
    return entries(df, payload).where("reason IS NOT NULL").select(*kept, payload, "reason")


def component_names(parsed: DataFrame) -> list[str]:
    """Every component key in the rows of :func:`entries`; runs a job whose result is the
    distinct keys."""
    keys = parsed.select(F.explode(F.map_keys("components")).alias("key")).distinct()
    return sorted(r["key"] for r in keys.collect())


def widened(parsed: DataFrame, components: Sequence[str] | dict[str, str], others: str | None = None) -> DataFrame:
    """Usable rows of :func:`entries` with one column per component, under its own name or the
    one it maps to; ``others`` names a map column for what is left, null if nothing is."""
    names = components if isinstance(components, dict) else {c: c for c in components}
    rest = [c for c in parsed.columns if c not in ("time", "openweather_aqi", "components", "reason", "payload")]
    left = F.map_filter("components", lambda k, v: ~k.isin(*names)) if names else F.col("components")
    extra = [F.when(F.size(left) > 0, left).alias(others)] if others else []
    return parsed.where("reason IS NULL").select(
        *rest, "time", *[F.try_element_at("components", F.lit(c)).alias(n) for c, n in names.items()], "openweather_aqi", *extra
    )


def flatten_pollution(
    df: DataFrame, payload: str = "payload", components: Sequence[str] | str = COMPONENTS, others: str | None = None
) -> DataFrame:
    """One row per list entry; the component map becomes one column per key.

    Keys outside ``components`` go to the map column ``others`` names, and are left out without
    one. ``components="all"`` takes every key that occurs: the parsed rows are then staged in
    the shared folder, so that the documents are scanned and parsed once; jobs run when this is
    called. Documents that cannot be used give no row; :func:`rejected_documents` has them, and
    :func:`entries` has both at once.
    """
    parsed = entries(df.withColumnRenamed(payload, "payload"))
    if components == "all":
        parsed = materialise(parsed.where("reason IS NULL"), "payloads")
        components = component_names(parsed)
    return widened(parsed, components, others)


def flatten_weather(df: DataFrame, payload: str = "payload", units: str = "metric") -> DataFrame:
    """One row per list entry; missing ``main`` or ``wind`` objects give nulls."""
    items = _items(df, payload, WEATHER_PAYLOAD)
    rest = [c for c in items.columns if c != "_item"]
    return items.select(*rest, _at(), *_weather(units))


def flatten_weather_current(df: DataFrame, payload: str = "payload") -> DataFrame:
    """A payload that is one observation rather than a list."""
    parsed = df.withColumn("_item", F.from_json(payload, WEATHER_ITEM)).drop(payload)
    return parsed.select(*[c for c in parsed.columns if c != "_item"], *_weather())


def flatten_monitor_aqi(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Reference-monitor reading; payloads without success status give no row."""
    parsed = df.withColumn("_p", F.from_json(payload, MONITOR_PAYLOAD)).drop(payload)
    at = "_p.data.current.pollution"
    return parsed.filter(F.col("_p.status") == "success").select(
        *[c for c in parsed.columns if c != "_p"],
        F.try_to_timestamp(F.col(f"{at}.ts")).alias("time"),
        F.col(f"{at}.aqius").alias("iqair_aqi"),
    )


def flatten_forecast(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Weather forecast; ``step_hour`` is the 1-based place in the list."""
    items = _items(df, payload, WEATHER_PAYLOAD, ordered=True)
    rest = [c for c in items.columns if c not in ("_pos", "_item")]
    return items.select(
        *rest, (F.col("_pos") + 1).alias("step_hour"), _at().alias("target_time"), *_weather()
    )


def flatten_pollution_forecast(df: DataFrame, payload: str = "payload", hours: int = 72) -> DataFrame:
    """First ``hours`` entries of the pollution forecast; an empty list fails the job."""
    parsed = df.withColumn("_p", F.from_json(payload, POLLUTION_PAYLOAD)).drop(payload)
    rest = [c for c in parsed.columns if c != "_p"]
    entries = F.when(F.size("_p.list") > 0, F.slice("_p.list", 1, hours)).otherwise(
        F.raise_error(F.lit("empty pollution forecast list"))
    )
    items = parsed.select(*rest, F.posexplode(entries).alias("_pos", "_item"))
    wanted = {k: v for k, v in {**POLLUTANT_NAMES, "nh3": "nh3"}.items() if k != "no2"}
    return items.select(
        *rest,
        (F.col("_pos") + 1).alias("step_hour"),
        _at().alias("target_time"),
        *[_component(k).alias(v) for k, v in wanted.items()],
    )


def normalise_components(payload: Column, fields=("pm2_5", "pm10")) -> list[Column]:
    """PM values from any of the payload shapes seen: root list or object, with a ``list``
    or without, ``components`` as object, list or flattened. Missing values are 0."""
    roots = ["$[0]", "$"]
    entries = [r + e for r in roots for e in (".list[0]", "")]
    places = [e + c for e in entries for c in (".components", ".components[0]", "")]
    return [
        F.coalesce(
            *[F.get_json_object(payload, f"{p}.{f}").try_cast("double") for p in places], F.lit(0.0)
        ).alias(f)
        for f in fields
    ]
