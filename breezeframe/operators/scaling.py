"""Group-wise standardisation with parameters kept as a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breezeframe.schema import KEYS, SCALE_GROUPS

WEATHER_ENCODER = SCALE_GROUPS["weather"] + ["wind_direction_sin", "wind_direction_cos"]


def scaler_groups(cols: Sequence[str]) -> dict[str, list[str]]:
    """Group of each column by its name: products first, then PM, weather, pollutants; others unscaled."""
    groups: dict[str, list[str]] = {"pm": [], "weather": [], "pollutant": [], "interaction": []}
    for c in cols:
        if "interaction" in c:
            groups["interaction"].append(c)
        elif c.startswith("pm") or "change_rate" in c:
            groups["pm"].append(c)
        elif c in WEATHER_ENCODER:
            groups["weather"].append(c)
        elif c in SCALE_GROUPS["pollutant"]:
            groups["pollutant"].append(c)
    return {g: cs for g, cs in groups.items() if cs}


def fit_scaler(
    df: DataFrame,
    groups: Mapping[str, Sequence[str]],
    train_flag: str | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """``(keys, grp, feature, mean, scale)`` from one aggregate over the training rows.

    Population deviation; nulls are left out; a constant feature scales by 1.
    """
    train = df.filter(F.col(train_flag)) if train_flag else df
    cells = [(g, c) for g, cs in groups.items() for c in cs if c in df.columns]
    one = train.groupBy(*keys).agg(
        *[f(c).alias(f"{p}_{c}") for _, c in cells for p, f in (("m", F.avg), ("s", F.stddev_pop))]
    )
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(g).alias("grp"),
            F.lit(c).alias("feature"),
            F.col(f"m_{c}").alias("mean"),
            F.when(F.col(f"s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"s_{c}")).alias("scale"),
        )
        for g, c in cells
    ]))
    return one.select(*keys, rows.alias("_r")).select(*keys, "_r.*")


def _beside(df: DataFrame, params: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Parameters as one struct column per feature; one row per key joins the data."""
    wide = params.groupBy(*keys).agg(*[
        F.max(F.when(F.col("feature") == c, F.struct("mean", "scale"))).alias(f"_p_{c}") for c in cols
    ])
    if keys:
        return df.join(wide, list(keys), "left")
    return df.withColumns({f"_p_{c}": wide.select(f"_p_{c}").scalar() for c in cols})


def _mapped(df, params, cols, keys, suffix, formula) -> DataFrame:
    out = _beside(df, params, cols, keys)
    new = {c: formula(F.col(c), F.col(f"_p_{c}.mean"), F.col(f"_p_{c}.scale")) for c in cols}
    if suffix:
        return out.select(*df.columns, *[v.alias(f"{c}{suffix}") for c, v in new.items()])
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def apply_scaler(
    df: DataFrame, params: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS, suffix: str = "_scaled"
) -> DataFrame:
    """Scaled copies of ``cols``, any subset of the fitted features (``suffix=""`` replaces them)."""
    return _mapped(df, params, list(cols), keys, suffix, lambda x, m, s: (x - m) / s)


def inverse_scaler(
    df: DataFrame, params: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS, suffix: str = ""
) -> DataFrame:
    return _mapped(df, params, list(cols), keys, suffix, lambda x, m, s: x * s + m)


