"""Forecast evaluation over long prediction tables ``(keys, base_time, h, target, y_true, y_pred)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeframe.functions.aqi import aqi_category, aqi_clamped
from breezeframe.operators.joins import first_n
from breezeframe.schema import KEYS, LOSS_BANDS


def _error() -> Column:
    return F.col("y_true") - F.col("y_pred")


def horizon_metrics(pred: DataFrame, by: Sequence[str] = (*KEYS, "h", "target")) -> DataFrame:
    """RMSE, MAE and R² per group in one pass; R² is null where the truth does not vary."""
    e = _error()
    y = F.col("y_true")
    spread = F.var_pop(y) * F.count(y)
    return pred.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.sum(e * e) / F.when(spread > 0, spread)).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


def merge_metrics(short: DataFrame, mid: DataFrame, cut: int = 12, prefer: str = "short") -> DataFrame:
    """Metrics of the short model up to ``cut`` hours, of the longer one beyond or where the
    short one has none."""
    from breezeframe.operators.shaping import band_merge

    merged = band_merge(short, mid, cut, prefer=prefer)
    by = [c for c in (*KEYS, "h", "target") if c in short.columns and c in mid.columns]
    return merged.unionByName(mid.join(merged.select(*by), by, "left_anti"))


def fold_average(metrics: DataFrame, by: Sequence[str] = (*KEYS, "h", "target")) -> DataFrame:
    """Mean of each metric across folds."""
    return metrics.groupBy(*by).agg(*[F.avg(m).alias(m) for m in ("rmse", "mae", "r2")])


def horizon_weight(h: Column, bands: Sequence[tuple[int, int, float]] = LOSS_BANDS) -> Column:
    return F.coalesce(*[F.when(h.between(a, b), F.lit(w)) for a, b, w in bands], F.lit(1.0))


def weighted_loss(pred: DataFrame, bands: Sequence[tuple[int, int, float]] = LOSS_BANDS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of (squared + 0.2 absolute error) times the weight of the horizon's band.

    The targets of a cell (base row and horizon) are averaged first, then cells count alike.
    """
    e = _error()
    cell = pred.groupBy(*keys, "base_time", "h").agg((F.avg(e * e) + F.avg(F.abs(e)) * 0.2).alias("loss"))
    return cell.groupBy(*keys).agg(F.avg(F.col("loss") * horizon_weight(F.col("h"), bands)).alias("loss"))


def band_errors(pred: DataFrame, lo: int = 6, hi: int = 24, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean squared error of one range of horizons."""
    e = _error()
    return pred.filter(F.col("h").between(lo, hi)).groupBy(*keys, "target").agg(F.avg(e * e).alias("mse"))


def error_listing(pred: DataFrame, n: int = 10, by: Sequence[str] = (*KEYS, "h", "target")) -> DataFrame:
    """First ``n`` predictions per group with difference and percent error (0 for a true 0)."""
    diff = F.col("y_pred") - F.col("y_true")
    pct = F.when(F.col("y_true") != 0, F.abs(diff) / F.col("y_true") * 100.0).otherwise(F.lit(0.0))
    return first_n(pred, n, by, ["base_time"]).withColumns({"diff": diff, "percent_error": pct})


def overfit_gap(
    train: DataFrame, test: DataFrame, by: Sequence[str] = (*KEYS, "h", "target"), limit: float = 0.1
) -> DataFrame:
    """Training against test R² and a flag where the gap exceeds ``limit``."""
    a = train.select(*by, F.col("r2").alias("train_r2"))
    b = test.select(*by, F.col("r2").alias("test_r2"))
    gap = F.col("train_r2") - F.col("test_r2")
    return a.join(b, list(by)).withColumns({"gap": gap, "overfit": gap > limit})


def category_accuracy(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of predictions in the right index category per forecast day and target."""
    day = (F.floor((F.col("h") - 1) / 24) + 1).cast("int")

    def category(c: str) -> Column:
        index = F.when(F.col("target") == "pm10", aqi_clamped(F.col(c), "pm10")).otherwise(
            aqi_clamped(F.col(c), "pm2_5")
        )
        return aqi_category(index)

    hit = (category("y_true") == category("y_pred")).cast("double")
    return pred.groupBy(*keys, "target", day.alias("day")).agg(
        F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n")
    )
