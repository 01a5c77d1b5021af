"""Exact quantiles without sorting a group on one task.

The built-in exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer. Here the wanted ranks of all columns are narrowed down together: a
mergeable sketch proposes narrow value bins around each of them, a count finds the bin that
truly holds the rank, and a bin of more than ``BOUND`` distinct values is counted once more in
slices of its value range. Only the last slice's distinct values are ordered. Sketch and slices
decide how much is ordered, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breezeframe.schema import KEYS

ACCURACY = 10_000
MARGIN = 0.0005
#: distinct values a bin may have before it is sliced, on average also those of a slice
BOUND = 1 << 16
#: rows of a group that may be sorted in one array
SMALL = 1 << 18


def _long(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])
    return df.select(*keys, F.explode(pairs).alias("_x")).select(*keys, "_x.column", "_x.v").filter(
        F.col("v").isNotNull()
    )


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], keys: Sequence[str] = KEYS, most: int | None = None
) -> DataFrame:
    """Long table ``(keys, column, p, value)``, linear interpolation between ranks.

    ``most`` is the number of rows that no group exceeds, if the caller has counted: groups of up
    to ``SMALL`` rows are sorted as arrays.
    """
    if most is not None and most <= SMALL:
        return _sorted_quantiles(df, cols, probs, keys)
    by = [*keys, "column"]
    found = _candidates(df, cols, probs, keys)
    low, high = F.min("v"), F.max("v")
    share = F.max(F.col("at") - F.floor("at"))
    return found.groupBy(*by, "p").agg((low + (high - low) * share).alias("value"))


def _sorted_quantiles(df, cols, probs, keys) -> DataFrame:
    arrays = df.groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.col(c).cast("double"))).alias(f"_a{i}") for i, c in enumerate(cols)])
    each = []
    for i, c in enumerate(cols):
        for p in probs:
            at = F.lit(float(p)) * (F.size(f"_a{i}") - 1)
            low, high = (F.get(f"_a{i}", f(at).cast("int")) for f in (F.floor, F.ceil))
            value = low + (high - low) * (at - F.floor(at))
            each.append(F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("p"), value.alias("value")))
    return arrays.select(*keys, F.inline(F.array(*each))).where("value IS NOT NULL")


def _sliced(values: DataFrame, by: Sequence[str], bin_: str, wanted: DataFrame) -> DataFrame:
    """Those of ``wanted`` (``by``, p, at, rank, ``lo``: values before) with the bin each rank
    falls into, the number of values before that bin, and its size and range."""
    bins = values.groupBy(*by, bin_).agg(
        F.sum("c").alias("_c"), F.count(F.lit(1)).alias("m"), F.min("v").alias("v0"), F.max("v").alias("v1")
    )
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy(bin_).rowsBetween(Window.unboundedPreceding, 0))
    placed = wanted.join(bins.withColumn("_upto", upto), list(by))
    inside = (F.col("rank") < F.col("lo") + F.col("_upto")) & (F.col("rank") >= F.col("lo") + F.col("_upto") - F.col("_c"))
    return placed.where(inside).withColumn("lo", F.col("lo") + F.col("_upto") - F.col("_c")).drop("_c", "_upto")


def _candidates(df, cols, probs, keys) -> DataFrame:
    """The values at the ranks either side of each wanted position."""
    by = [*keys, "column"]
    long = _long(df, cols, keys)
    # equal readings travel once
    values = long.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c"))
    at = sorted({min(max(q, 0.0), 1.0) for p in probs for q in (p - MARGIN, p + MARGIN)})
    sketch = long.groupBy(*by).agg(
        F.percentile_approx("v", F.array(*[F.lit(q) for q in at]), ACCURACY).alias("edges"), F.count(F.lit(1)).alias("n")
    )
    # bin = number of edges below the value: monotone in v whatever the edges are
    binned = values.join(sketch.drop("n"), by).select(
        *by, "v", "c",
        F.aggregate("edges", F.lit(0), lambda a, e: a + (e < F.col("v")).cast("int")).alias("bin"),
    )
    ranks = (
        sketch.drop("edges").withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("at", F.col("p") * (F.col("n") - 1))
        .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
        .select(*by, "p", "at", "rank", F.lit(0).cast("bigint").alias("lo"))
    )
    wanted = _sliced(binned, by, "bin", ranks).withColumn("slices", F.ceil(F.col("m") / BOUND)).drop("m")
    held = binned.join(wanted.select(*by, "bin", "v0", "v1", "slices").distinct(), [*by, "bin"])
    place = F.floor((F.col("v") - F.col("v0")) / (F.col("v1") - F.col("v0")) * F.col("slices"))
    # a range without width or without bounds has no place: one slice
    last = F.col("slices") - 1
    spread = (F.col("slices") > 1) & (F.col("v1") > F.col("v0")) & (F.col("v1") - F.col("v0") < float("inf"))
    held = held.withColumn("slice", F.when(spread, F.least(place, last)).otherwise(0)).drop("v0", "v1", "slices")
    final = _sliced(held, [*by, "bin"], "slice", wanted.drop("v0", "v1", "slices"))
    inside = Window.partitionBy(*by, "bin", "slice").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = held.join(final.select(*by, "bin", "slice").distinct(), [*by, "bin", "slice"]).select(
        *by, "bin", "slice", "v", "c", F.sum("c").over(inside).alias("hi")
    )
    return ordered.join(final, [*by, "bin", "slice"]).filter(
        (F.col("rank") < F.col("lo") + F.col("hi")) & (F.col("rank") >= F.col("lo") + F.col("hi") - F.col("c"))
    )


def wide_quantiles(q: DataFrame, probs: Sequence[float], names: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per key and column, one named field per probability."""
    return q.groupBy(*keys, "column").agg(
        *[F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(n) for p, n in zip(probs, names)]
    )


def beside(df: DataFrame, params: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Per-key parameters beside every row of the key; scalar subqueries when there is no key."""
    if not keys:
        return df.withColumns({n: params.select(n).scalar() for n in names})
    return df.join(params, list(keys))
