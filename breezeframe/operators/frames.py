"""Supervised frames: future targets, encoder windows, folds and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breezeframe.functions.features import TAU
from breezeframe.operators.layout import core, piece_window, position_halo, with_position
from breezeframe.operators.windows import shift
from breezeframe.schema import (
    CYCLIC_COLUMNS,
    KEYS,
    SCALE_GROUPS,
    SEQ,
    TARGETS,
    TIME,
    TREE_EXOG_FLAGS,
    TREE_EXOG_INTERACTIONS,
    TREE_EXOG_POLLUTANTS,
    TREE_EXOG_WEATHER,
)


def targets(
    df: DataFrame, cols: Sequence[str] = TARGETS, horizons: Sequence[int] = (1,), keys: Sequence[str] = KEYS
) -> DataFrame:
    """Future values side by side: ``<col>_target_<h>h``."""
    return shift(df, {f"{c}_target_{h}h": (c, -h) for c in cols for h in horizons}, keys)


def targets_long(
    df: DataFrame, cols: Sequence[str], horizons: Sequence[int], keys: Sequence[str] = KEYS, time: str = TIME,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Future values one per row ``(keys, time, carry, target, h, y_base, y)``; no shuffle
    beyond the shift's."""
    slim = df.select(*dict.fromkeys([*keys, time, SEQ, *carry, *cols]))
    wide = shift(slim, {f"_y_{c}_{h}": (c, -h) for c in cols for h in horizons}, keys)
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("target"), F.lit(h).alias("h"), F.col(c).alias("y_base"), F.col(f"_y_{c}_{h}").alias("y")
        )
        for c in cols
        for h in horizons
    ])
    kept = [*keys, time, *carry]
    return wide.select(*kept, F.explode(cells).alias("_c")).select(*kept, "_c.*")


def exogenous_columns(df: DataFrame) -> list[str]:
    """What a decoder may know about a future hour, in training order."""
    scaled = [f"{c}_scaled" for g in ("weather", "pollutant") for c in SCALE_GROUPS[g]]
    order = [*scaled[:4], "wind_direction_sin", "wind_direction_cos", *scaled[4:], *CYCLIC_COLUMNS]
    return [c for c in order if c in df.columns]


def tree_exogenous_columns(df: DataFrame) -> list[str]:
    """What the tree trainers read at the horizon, raw and scaled, in training order."""
    pairs = lambda names: [x for c in names for x in (c, f"{c}_scaled")]
    order = [
        *pairs(TREE_EXOG_WEATHER), *pairs(TREE_EXOG_POLLUTANTS), "wind_direction_sin", "wind_direction_cos",
        *TREE_EXOG_FLAGS, *CYCLIC_COLUMNS, *pairs(TREE_EXOG_INTERACTIONS),
    ]
    return [c for c in order if c in df.columns]


def exog_at_horizon(
    df: DataFrame, horizons: Sequence[int], cols: Sequence[str] | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Exogenous columns read ``h`` rows ahead, ``<col>_target_<h>h``, built in one projection."""
    cols = exogenous_columns(df) if cols is None else cols
    return shift(df, {f"{c}_target_{h}h": (c, -h) for h in horizons for c in cols}, keys)


def encoder_windows(
    df: DataFrame, features: Sequence[str], seq_len: int, steps: int, keys: Sequence[str] = KEYS, time: str = TIME
) -> DataFrame:
    """Per base row i the ``seq_len`` rows before it, and the PM values of the ``steps`` after it.

    Bases run from row ``seq_len`` to ``n - steps`` (0-based, end excluded). Each window
    holds ``seq_len`` rows by definition, so the lists are bounded.
    """
    numbered = with_position(df, keys, "_pos", total="_n", time=time)
    cut = position_halo(numbered, seq_len, steps, "_pos")
    w = piece_window(keys).orderBy("_pos")
    row = F.array(*[F.col(f).cast("double") for f in features])
    pm = F.array(*[F.col(t).cast("double") for t in TARGETS])
    windows = cut.select(
        *keys, time, "_pos", "_n", "_core", "_piece", F.lit(None).alias("_us"),
        F.collect_list(row).over(w.rowsBetween(-seq_len, -1)).alias("encoder"),
        F.collect_list(pm).over(w.rowsBetween(1, steps)).alias("targets"),
    )
    base = F.col("_pos") - 1
    kept = core(windows).filter((base >= seq_len) & (base < F.col("_n") - steps))
    return kept.select(*keys, time, base.alias("base"), "encoder", "targets")


def target_windows(
    df: DataFrame, seq_len: int, steps: int, cols: Sequence[str] = TARGETS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Long form of the target windows: ``(keys, base, h, target, y)`` for rows i+1 .. i+steps."""
    numbered = with_position(df, keys, "_pos", total="_n")
    slim = numbered.select(*keys, SEQ, TIME, "_pos", "_n", *cols)
    wide = shift(
        slim, {f"_y_{c}_{h}": (c, -h) for c in cols for h in range(1, steps + 1)}, keys, pos="_pos"
    )
    base = F.col("_pos") - 1
    cells = F.array(*[
        F.struct(F.lit(h).alias("h"), *[F.col(f"_y_{c}_{h}").alias(c) for c in cols])
        for h in range(1, steps + 1)
    ])
    return (
        wide.filter((base >= seq_len) & (base < F.col("_n") - steps))
        .select(*keys, base.alias("base"), F.explode(cells).alias("_c"))
        .select(*keys, "base", "_c.*")
    )


def teacher_pairs(df: DataFrame, steps: int, cols: Sequence[str] = TARGETS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Decoder inputs: for step h the value at i+h-1 beside the target at i+h."""
    slim = df.select(*keys, TIME, SEQ, *cols)
    wide = shift(slim, {f"_y_{c}_{h}": (c, -h) for c in cols for h in range(0, steps + 1)}, keys)
    cells = F.array(*[
        F.struct(
            F.lit(h).alias("h"),
            *[F.col(f"_y_{c}_{h - 1}").alias(f"prev_{c}") for c in cols],
            *[F.col(f"_y_{c}_{h}").alias(f"target_{c}") for c in cols],
        )
        for h in range(1, steps + 1)
    ])
    return wide.select(*keys, TIME, F.explode(cells).alias("_c")).select(*keys, TIME, "_c.*")


def horizon_tensor(
    df: DataFrame, horizons: Sequence[int], cols: Sequence[str], keys: Sequence[str] = KEYS
) -> DataFrame:
    """Long ``(keys, time, h, feature, value)``; missing values are 0."""
    long = targets_long(df, cols, horizons, keys)
    return long.select(
        *keys, TIME, "h", F.col("target").alias("feature"), F.coalesce("y", F.lit(0.0)).alias("value")
    )


def horizon_arrays(
    df: DataFrame, cols: Sequence[str], steps: int, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Each column's values at 1..``steps`` rows ahead, as one array per base row."""
    wide = shift(
        df.select(*dict.fromkeys([*keys, TIME, SEQ, *cols])),
        {f"_y_{c}_{h}": (c, -h) for c in cols for h in range(1, steps + 1)},
        keys,
    )
    return wide.select(
        *keys, TIME, *[F.array(*[F.col(f"_y_{c}_{h}") for h in range(1, steps + 1)]).alias(c) for c in cols]
    )


def ar1_noise(
    df: DataFrame,
    cols: Sequence[str],
    lo: float,
    hi: float,
    steps: int,
    rho: float = 0.8,
    seed: int = 7,
    row: Sequence[str] = (*KEYS, TIME),
) -> DataFrame:
    """Add AR(1) noise along the horizon to array columns of ``steps`` values.

    The innovations' deviation grows linearly from ``lo`` to ``hi``. Each is a Box-Muller
    draw from the MD5 of (row, column, step), times as microseconds: a retried task, another
    partitioning or another engine gives the same noise, and no row needs a neighbour.
    """
    kinds = dict(df.dtypes)
    place = [F.unix_micros(r) if kinds[r].startswith("timestamp") else F.col(r) for r in row]

    def uniform(tag: str, c: str, s):
        text = F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in place], F.lit(c), s.cast("string"), F.lit(f"{tag}{seed}"))
        bits = F.conv(F.substring(F.md5(text), 1, 10), 16, 10).cast("double")
        return (bits + 0.5) / F.lit(float(2**40))

    def innovation(c: str, s):
        normal = F.sqrt(F.log(uniform("u", c, s)) * -2.0) * F.cos(uniform("v", c, s) * TAU)
        return (F.lit(lo) + (s - 1) * F.lit((hi - lo) / max(steps - 1, 1))) * normal

    def noise(c: str):
        start = F.struct(F.lit(0.0).alias("e"), F.array().cast("array<double>").alias("all"))

        def step(acc, s):
            e = acc["e"] * rho + innovation(c, s)
            return F.struct(e.alias("e"), F.array_append(acc["all"], e).alias("all"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: acc["all"])

    return df.withColumns({c: F.zip_with(c, noise(c), lambda x, e: x + e) for c in cols})


# --- splits --------------------------------------------------------------------------


def chrono_split(df: DataFrame, test: float = 0.2, rule: str = "floor", keys: Sequence[str] = KEYS) -> DataFrame:
    """Flag ``is_train`` on the first part of each station's rows.

    ``floor`` takes int((1 - test) * n) training rows, ``ceil`` leaves ceil(test * n) for testing.
    """
    numbered = with_position(df, keys, "_pos", total="_n")
    n = F.col("_n")
    size = F.floor(F.lit(1.0 - test) * n) if rule == "floor" else n - F.ceil(F.lit(test) * n)
    return numbered.withColumn("is_train", F.col("_pos") <= size).drop("_pos", "_n")


def fold_fractions(k: int = 4, first: float = 0.55, last: float = 0.95) -> list[float]:
    return [first + (last - first) * i / max(k - 1, 1) for i in range(k)]


def walk_forward(df: DataFrame, k: int = 4, keys: Sequence[str] = KEYS) -> DataFrame:
    """Growing folds: fold f holds each station's first round(fraction * n) rows, clamped to [1, n-1]."""
    numbered = with_position(df, keys, "_pos", total="_n")
    ends = [
        F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.bround(F.lit(f) * F.col("_n")))).cast("bigint")
        for f in fold_fractions(k)
    ]
    folds = F.array(*[
        F.struct(F.lit(i + 1).alias("fold"), e.alias("fold_end")) for i, e in enumerate(ends)
    ])
    inside = F.filter(folds, lambda f: F.col("_pos") <= f["fold_end"])
    return numbered.withColumn("_f", F.explode(inside)).select(*df.columns, "_f.fold", "_f.fold_end")


def delta_targets(df: DataFrame, y: str = "y", base: str = "y_base", out: str = "y_delta") -> DataFrame:
    """Target as the change from the value at the base row (both already scaled)."""
    return df.withColumn(out, F.col(y) - F.col(base))


def undo_delta(df: DataFrame, delta: str = "y_delta", base: str = "y_base", out: str = "y") -> DataFrame:
    return df.withColumn(out, F.col(base) + F.col(delta))
