"""Column and row selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breezeframe.functions.features import finite
from breezeframe.operators.quantiles import beside, exact_quantiles, wide_quantiles
from breezeframe.schema import (
    CLEAN_FEATURES,
    ENCODER_FEATURES,
    FLAG_COLUMNS,
    IQR_COLUMNS,
    KEYS,
    POLLUTANT_NAMES,
    STATIC_COLUMNS,
    TARGETS,
    TIME,
    TREE_FEATURES,
    TREE_FEATURES_LATER,
    TREE_FEATURES_MULTI,
    TREE_STEP_FEATURES,
    VALIDATION_COLUMNS,
)
from breezeframe.session import materialise


def normalise_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(POLLUTANT_NAMES)


def ensure_columns(df: DataFrame, cols: Sequence[str], dtype: str = "double") -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(dtype) for c in cols if c not in df.columns})


def with_location(df: DataFrame, city: str, latitude: float, longitude: float) -> DataFrame:
    return df.withColumns(
        {"city": F.lit(city), "latitude": F.lit(latitude), "longitude": F.lit(longitude)}
    )


def cast_schema(df: DataFrame, keep: Sequence[str] = ("seq",)) -> DataFrame:
    """Flags to bigint, every other number to double."""
    kinds = {
        f.name: "bigint" if f.name in FLAG_COLUMNS or f.name.startswith("is_") else "double"
        for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in keep
    }
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])


def drop_static(df: DataFrame, validation: bool = True) -> DataFrame:
    return df.drop(*STATIC_COLUMNS, *(VALIDATION_COLUMNS if validation else []))


def select_clean(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.select(*keys, *[c for c in CLEAN_FEATURES if c in df.columns])


def feature_columns(df: DataFrame, exclude_targets: bool = True, also: Sequence[str] = ()) -> list[str]:
    out = {*STATIC_COLUMNS, *VALIDATION_COLUMNS, *also, *(TARGETS if exclude_targets else [])}
    return [c for c in df.columns if c not in out]


def model_features(df: DataFrame, model: str, horizons: Sequence[int] = ()) -> list[str]:
    """What a model is trained on, as far as ``df`` has it, in training order.

    ``tree_multi``: one model for all horizons, with the exogenous columns at ``horizons`` if
    given. ``tree_direct``: one-step model with those of the next hour. ``encoder``: raw columns.
    """
    if model == "encoder":
        wanted = ENCODER_FEATURES
    elif model == "tree_multi":
        wanted = [*TREE_FEATURES, *TREE_FEATURES_MULTI, *TREE_FEATURES_LATER]
        wanted += [f"{c}_target_{h}h" for h in horizons for c in TREE_STEP_FEATURES]
    elif model == "tree_direct":
        wanted = [*TREE_FEATURES, *TREE_FEATURES_LATER, *[f"{c}_target_1h" for c in TREE_STEP_FEATURES]]
    else:
        raise ValueError(f"unknown model {model!r}")
    have = set(df.columns)
    return [c for c in wanted if c in have]


def columns_like(df: DataFrame, *patterns: str, prefix: str = "", kind: str | None = None) -> list[str]:
    """Columns containing any pattern, with a prefix, or of a kind (numeric, datetime, text)."""
    kinds = {
        "numeric": T.NumericType,
        "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType),
        "text": T.StringType,
    }
    return [
        f.name
        for f in df.schema
        if (not patterns or any(p in f.name for p in patterns))
        and f.name.startswith(prefix)
        and (kind is None or isinstance(f.dataType, kinds[kind]))
    ]


def drop_bad_time(df: DataFrame, time: str = TIME) -> DataFrame:
    return df.filter(F.col(time).isNotNull())


def keep_positive(df: DataFrame, cols: Sequence[str] = TARGETS) -> DataFrame:
    for c in cols:
        df = df.filter(F.col(c) > 0)
    return df


def drop_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(cols) if cols else None)


def inf_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[
        finite(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name)
        for f in df.schema
    ])


def iqr_filter_seq(
    df: DataFrame, cols: Sequence[str] = IQR_COLUMNS, k: float = 1.5, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Interquartile filter, column after column: each column's quartiles come from the rows
    that survived the columns before it. Null readings fail.

    Runs its jobs when called. Keys and checked columns are written once; a round reads them past
    the fences found so far, one row of fences per key, and adds its own to that row. Groups that
    turned out small are sorted as arrays. ``df`` itself is joined once, with all fences: the
    filters are a conjunction.
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    slim = materialise(df.select(*keys, *cols), "iqr-columns")
    most = slim.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    fences, names, left = None, [], slim
    for i, c in enumerate(cols):
        q = exact_quantiles(left, [c], [0.25, 0.75], keys, most)
        q = wide_quantiles(q, [0.25, 0.75], ["_q1", "_q3"], keys)
        width = (F.col("_q3") - F.col("_q1")) * k
        fence = q.select(*keys, (F.col("_q1") - width).alias(f"_lo{i}"), (F.col("_q3") + width).alias(f"_hi{i}"))
        if fences is not None:
            fence = fences.join(fence, list(keys)) if keys else fences.crossJoin(fence)
        fences = materialise(fence, "quartiles")
        names += [f"_lo{i}", f"_hi{i}"]
        left = _inside(slim, fences, cols[: i + 1], names, keys)
    return _inside(df, fences, cols, names, keys)


def _inside(df: DataFrame, fences: DataFrame, cols: Sequence[str], names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    out = beside(df, fences, keys, names)
    for i, c in enumerate(cols):
        out = out.filter(F.col(c).between(F.col(f"_lo{i}"), F.col(f"_hi{i}")))
    return out.drop(*names)


def band_merge(short: DataFrame, mid: DataFrame, cut: int = 12, h: str = "h", prefer: str = "short") -> DataFrame:
    """Steps up to ``cut`` from one forecast, later ones from the other.

    ``prefer="mid"`` gives the boundary step itself to the longer forecast.
    """
    last_short = cut if prefer == "short" else cut - 1
    return short.filter(F.col(h) <= last_short).unionByName(mid.filter(F.col(h) > last_short))
