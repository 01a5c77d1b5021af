"""Time-tolerant lags, time-range statistics, change rates, fills and row shifts.

No frame here is re-scanned per row: lags read frames that only grow, and range
statistics are put together from running bucket aggregates, so the cost does not depend
on how many readings fall into a window.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breezeframe.operators.layout import (
    CHUNK_HOURS,
    PIECE,
    US,
    US_PER_HOUR,
    carried,
    core,
    floor_div,
    micros,
    piece_window,
    position_halo,
    tasks_for,
    with_position,
)
from breezeframe.schema import (
    CHANGE_HOURS,
    EXTRA_LAGS,
    EXTRA_ROLLING_COLUMNS,
    EXTRA_ROLLING_HOURS,
    KEYS,
    LAG_HOURS,
    LAG_TOLERANCE_MINUTES,
    ROLLING_HOURS,
    ROLLING_STATS,
    SEQ,
    TARGETS,
    TIME,
)
from breezeframe.session import materialise


class Lag(NamedTuple):
    """Value of ``column`` about ``hours`` ago."""

    name: str
    column: str
    hours: int
    tolerance_minutes: int | None = None

    @property
    def tolerance(self) -> int:
        return self.tolerance_minutes or LAG_TOLERANCE_MINUTES.get(self.hours, 60)


class Rolling(NamedTuple):
    """Statistic of ``column`` over the last ``hours``, both ends included."""

    name: str
    column: str
    hours: int
    stat: str


class Change(NamedTuple):
    """Relative change of ``column`` against its tolerant lag."""

    name: str
    column: str
    hours: int


def target_lags(targets: Sequence[str] = TARGETS, hours: Sequence[int] = LAG_HOURS) -> list[Lag]:
    return [Lag(f"{t}_lag_{h}h", t, h) for t in targets for h in hours]


def extra_lags() -> list[Lag]:
    return [Lag(name, col, h) for name, (col, h) in EXTRA_LAGS.items()]


def target_rolling(
    targets: Sequence[str] = TARGETS,
    hours: Sequence[int] = ROLLING_HOURS,
    stats: Sequence[str] = ROLLING_STATS,
) -> list[Rolling]:
    return [Rolling(f"{t}_rolling_{s}_{h}h", t, h, s) for t in targets for h in hours for s in stats]


def extra_rolling() -> list[Rolling]:
    return [
        Rolling(f"{short}_rolling_mean_{h}h", col, h, "mean")
        for h in EXTRA_ROLLING_HOURS
        for short, col in EXTRA_ROLLING_COLUMNS.items()
    ]


def target_changes(targets: Sequence[str] = TARGETS) -> list[Change]:
    return [Change(f"{t}_change_rate_{h}h", t, h) for t in targets for h in CHANGE_HOURS]


# --- lags and range statistics -------------------------------------------------------


#: buckets an hour may be cut into, and the rows, copies included, one is meant to hold: few
#: enough that those a task is dealt by chance differ little in sum
SPLITS = (1, 2, 4, 6, 12, 30, 60, 300, 3600)
BUCKET_ROWS = 20_000
#: how far a copy is moved in hours; null for the row itself
MOVED = "_d"
AXIS, AGAINST = "_x", "_nx"

def relative_change(now: Column, before: Column) -> Column:
    """(now - before) / before; null where either is missing or ``before`` is zero."""
    return F.when(before != 0, (now - before) / before)


def reach_of(lags: Iterable[Lag], rolls: Iterable[Rolling], changes: Iterable[Change]):
    probes = [*lags, *[Lag(c.name, c.column, c.hours) for c in changes]]
    back = max([p.hours + p.tolerance / 60 for p in probes] + [r.hours for r in rolls] + [0])
    ahead = max([p.tolerance / 60 - p.hours for p in probes] + [0])
    return back, ahead


def window_features(
    df: DataFrame,
    lags: Iterable[Lag] = (),
    rolls: Iterable[Rolling] = (),
    changes: Iterable[Change] = (),
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    seq: str = SEQ,
    chunk_hours: float | str = CHUNK_HOURS,
    source: DataFrame | None = None,
) -> DataFrame:
    """All lags, range statistics and change rates behind a single shuffle of the rows.

    A series is cut into buckets of an hour, or less where it is dense or ``chunk_hours`` says so
    (``auto``: by density alone). A row goes to its own bucket and, moved by each lag and each window's width, to the bucket where it is
    looked back at; it is sorted there once along time and once against it, whatever the number
    of features. What lies further off comes from a table with one row per key and bucket (see
    ``_surroundings``), which is written when this is called. So a task holds few rows, however
    far the features reach and however dense a series is.

    ``source`` may hold the same rows in a form that is cheaper to read twice.
    """
    lags, rolls, changes = list(lags), list(rolls), list(changes)
    probes = [Lag(c.name, c.column, c.hours) for c in changes]
    pairs: dict[tuple[int, int], list[str]] = {}
    for spec in [*lags, *probes]:
        cols = pairs.setdefault((spec.hours, spec.tolerance), [])
        if spec.column not in cols:
            cols.append(spec.column)
    if not pairs and not rolls:
        return df
    used = list(dict.fromkeys([*(c for cols in pairs.values() for c in cols), *(r.column for r in rolls)]))
    parts: dict[int, list[tuple[str, str]]] = {}
    for r in rolls:
        mine = parts.setdefault(r.hours, [])
        mine += [(r.column, p) for p in _PARTS[r.stat] if (r.column, p) not in mine]

    def narrow(rows: DataFrame, *more: Column) -> DataFrame:
        place = [F.col(seq).alias("_seq")] if pairs else []
        values = [F.col(c).alias(f"_v_{c}") for c in used]
        return rows.where(F.col(time).isNotNull()).select(*keys, micros(time).alias(US), *place, *values, *more)

    slim = narrow(df if source is None else source)
    moves = sorted({h for h, _ in pairs} | set(parts))
    n_rows, densest = _measured(slim, keys)
    least = 1 if chunk_hours == "auto" else 1 / chunk_hours
    per_hour = next((n for n in SPLITS if n >= least and densest * (1 + len(moves)) <= n * BUCKET_ROWS), SPLITS[-1])
    width = US_PER_HOUR // per_hour
    around = _surroundings(slim, pairs, parts, keys, per_hour, width, tasks_for(df.sparkSession, n_rows))

    copies = F.array(F.lit(None).cast("int"), *[F.lit(h) for h in moves])
    events = (
        narrow(df, F.struct(*df.columns).alias("_row"))
        .withColumn(MOVED, F.explode(copies))
        .withColumn("_row", F.when(F.col(MOVED).isNull(), F.col("_row")))
        .withColumn(AXIS, F.col(US) + F.coalesce(F.col(MOVED), F.lit(0)).cast("bigint") * US_PER_HOUR)
        .withColumn(AGAINST, -F.col(AXIS))
        .withColumn(PIECE, floor_div(F.col(AXIS), width))
        .repartition(tasks_for(df.sparkSession, n_rows * (1 + len(moves))), *keys, PIECE)
    )
    near = _against_time(_along_time(events, pairs, parts, keys), pairs, parts, keys)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    whole = near.alias("a").join(around.alias("b"), reduce(and_, same, F.col(f"a.{PIECE}") == F.col(f"b.{PIECE}")), "left")
    whole = whole.select("a.*", *[f"b.{c}" for c in around.columns if c not in {*keys, PIECE}])
    whole = _picked(_reached(whole, parts), pairs)

    def at(spec: Lag) -> Column:
        return F.col(f"_at_{spec.hours}_{spec.tolerance}._v_{spec.column}")

    return whole.select(
        *[F.col("_row")[c].alias(c) for c in df.columns],
        *[
            F.expr(f"CASE WHEN _h_rows + _w{r.hours}_rows >= 2 THEN {_merged(r.column, r.stat, r.hours)} END").alias(r.name)
            for r in rolls
        ],
        *[at(s).alias(s.name) for s in lags],
        *[relative_change(F.col("_row")[p.column], at(p)).alias(p.name) for p in probes],
    )


def asof_lag(df: DataFrame, column: str, hours: int, tolerance_minutes: int, name: str, **kw):
    return window_features(df, lags=[Lag(name, column, hours, tolerance_minutes)], **kw)


_PARTS = {"mean": ("n", "m"), "std": ("n", "m", "v"), "min": ("lo",), "max": ("hi",)}
_AGGREGATES = {"n": "count", "m": "avg", "v": "var_pop", "lo": "min", "hi": "max"}


def _measured(slim: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """How many rows there are, and in the densest hour of a key."""
    hourly = slim.groupBy(*keys, floor_div(F.col(US), US_PER_HOUR)).agg(F.count(F.lit(1)).alias("n"))
    found = hourly.agg(F.sum("n").alias("rows"), F.max("n").alias("densest")).first()
    return found["rows"] or 0, found["densest"] or 0


def _stored(cols: Sequence[str], first: bool) -> str:
    """Ordered by time; among equal timestamps the first stored row stands for all, whether the
    least (``first``) or the greatest is taken."""
    return f"named_struct('us', {US}, 's', {'' if first else '-'}_seq, " + ", ".join(f"'_v_{c}', _v_{c}" for c in cols) + ")"


def _bound(rows: int) -> str:
    return f"{rows}L FOLLOWING" if rows > 0 else f"{-rows}L PRECEDING" if rows else "CURRENT ROW"


def _every(parts: dict[int, list[tuple[str, str]]]) -> list[tuple[str, str]]:
    return list(dict.fromkeys(x for some in parts.values() for x in some))


def _surroundings(slim: DataFrame, pairs, parts, keys, per_hour: int, width: int, tasks: int) -> DataFrame:
    """What the rows of a bucket need of other buckets, one row per key and bucket.

    For a window of H hours: the statistics of the buckets that lie in it whole, whichever row
    of the bucket it ends at, without the bucket itself. For a lag: the last row before the
    moved bucket and the first one after it. Only this table is ordered over a whole series.
    """
    slim = slim.withColumn(PIECE, floor_div(F.col(US), width))
    if pairs:  # rows are compared whole, which takes a sort: over tasks of a bounded size
        slim = slim.repartition(tasks, *keys, PIECE)
    ends = [x for i, cols in enumerate(pairs.values()) for x in (
        F.expr(f"max({_stored(cols, False)})").alias(f"_last{i}"), F.expr(f"min({_stored(cols, True)})").alias(f"_first{i}"))]
    per = slim.groupBy(*keys, PIECE).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.expr(f"{_AGGREGATES[p]}(_v_{c})").alias(f"_{p}_{c}") for c, p in _every(parts)],
        *ends,
    )
    part, out, folds = ", ".join(keys), [*keys, PIECE], []
    for h, some in parts.items():
        full = h * per_hour - 1
        frame = f"OVER (PARTITION BY {part} ORDER BY {PIECE} RANGE BETWEEN {full}L PRECEDING AND 1L PRECEDING)"
        out.append(f"sum(_rows) {frame} AS _m{h}_rows" if full else f"0L AS _m{h}_rows")
        for c, p in some:
            if p in ("lo", "hi"):
                out.append(f"{_AGGREGATES[p]}(_{p}_{c}) {frame} AS _m{h}_{p}_{c}" if full else f"CAST(NULL AS DOUBLE) AS _m{h}_{p}_{c}")
            elif p == "n":
                spread = f"_v_{c} * _n_{c}" if (c, "v") in some else "0D"
                one = f"named_struct('n', _n_{c}, 'm', coalesce(CAST(_m_{c} AS DOUBLE), 0D), 's', coalesce({spread}, 0D))"
                out.append(f"collect_list({one}) {frame} AS _m{h}_{c}" if full else f"slice(array({one}), 1, 0) AS _m{h}_{c}")
                folds.append(f"_m{h}_{c}")
    for i, (h, _) in enumerate(pairs):
        out.append(f"max(_last{i}) OVER (PARTITION BY {part} ORDER BY {PIECE} "
                   f"RANGE BETWEEN UNBOUNDED PRECEDING AND {_bound(-h * per_hour - 1)}) AS _last_{i}")
        out.append(f"min(_first{i}) OVER (PARTITION BY {part} ORDER BY _back "
                   f"RANGE BETWEEN UNBOUNDED PRECEDING AND {_bound(h * per_hour - 1)}) AS _first_{i}")
    found = per.withColumn("_back", -F.col(PIECE)).selectExpr(*out)
    folded = {
        f: F.expr(
            f"aggregate({f}, named_struct('n', 0L, 'm', 0D, 's', 0D), (a, b) -> CASE WHEN b.n = 0 THEN a WHEN a.n = 0 THEN b "
            "ELSE named_struct('n', a.n + b.n, 'm', (a.m * a.n + b.m * b.n) / (a.n + b.n), "
            "'s', a.s + b.s + (a.m - b.m) * (a.m - b.m) * a.n * b.n / (a.n + b.n)) END)"
        )
        for f in folds
    }
    return materialise(found.select(*[folded[c].alias(c) if c in folded else F.col(c) for c in found.columns]), "surroundings")


def _growing(keys: Sequence[str], order: str) -> str:
    return f"OVER (PARTITION BY {', '.join([*keys, PIECE])} ORDER BY {order} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _along_time(events: DataFrame, pairs, parts, keys) -> DataFrame:
    """Per row: statistics of its bucket up to the row, and for each lag the last moved row up to it."""
    frame, own = _growing(keys, AXIS), f"{MOVED} IS NULL"
    befores = [
        f"max(CASE WHEN {MOVED} = {h} THEN {_stored(cols, False)} END) {frame} AS _b{i}"
        for i, ((h, _), cols) in enumerate(pairs.items())
    ]
    heads = [f"count(CASE WHEN {own} THEN 1 END) {frame} AS _h_rows"] if parts else []
    heads += [f"{_AGGREGATES[p]}(CASE WHEN {own} THEN _v_{c} END) {frame} AS _h_{p}_{c}" for c, p in _every(parts)]
    known = events.columns
    # copies are sorted once more, so they leave behind what only rows need
    held = [f"CASE WHEN {own} THEN _b{i} END AS _b{i}" for i in range(len(pairs))]
    names = [x.rsplit(" AS ", 1)[1] for x in heads]
    return events.selectExpr("*", *heads, *befores).selectExpr(*known, *names, *held)


def _against_time(events: DataFrame, pairs, parts, keys) -> DataFrame:
    """Rows only, each with the moved rows from it to the end of its bucket: statistics for each
    window, the first one for each lag."""
    frame = _growing(keys, AGAINST)
    out = []
    for h, some in parts.items():
        out.append(f"count(CASE WHEN {MOVED} = {h} THEN 1 END) {frame} AS _t{h}_rows")
        out += [f"{_AGGREGATES[p]}(CASE WHEN {MOVED} = {h} THEN _v_{c} END) {frame} AS _t{h}_{p}_{c}" for c, p in some]
    for i, ((h, _), cols) in enumerate(pairs.items()):
        out.append(f"min(CASE WHEN {MOVED} = {h} THEN {_stored(cols, True)} END) {frame} AS _a{i}")
    return events.selectExpr("*", *out).where(F.col(MOVED).isNull())


def _reached(rows: DataFrame, parts) -> DataFrame:
    """Per window ``_w<h>_``: the moved rows of the bucket and the whole buckets put together."""
    out = []
    for h, some in parts.items():
        out.append(f"_t{h}_rows + coalesce(_m{h}_rows, 0L) AS _w{h}_rows")
        for c, p in some:
            n, m, s = (f"coalesce(_m{h}_{c}.{x}, 0)" for x in "nms")
            nt, mt = f"_t{h}_n_{c}", f"coalesce(_t{h}_m_{c}, 0D)"
            total = f"nullif({nt} + {n}, 0)"
            value = {
                "lo": f"least(_t{h}_lo_{c}, _m{h}_lo_{c})",
                "hi": f"greatest(_t{h}_hi_{c}, _m{h}_hi_{c})",
                "n": f"{nt} + {n}",
                "m": f"({mt} * {nt} + {m} * {n}) / {total}",
                "v": f"coalesce(_t{h}_v_{c}, 0D) * {nt} + {s} + coalesce(({mt} - {m}) * ({mt} - {m}) * {nt} * {n} / {total}, 0D)",
            }[p]
            out.append(f"{value} AS _w{h}_{p}_{c}")
    return rows.selectExpr("*", *out)


def _merged(c: str, stat: str, h: int) -> str:
    if stat == "min":
        return f"least(_h_lo_{c}, _w{h}_lo_{c})"
    if stat == "max":
        return f"greatest(_h_hi_{c}, _w{h}_hi_{c})"
    nh, nw = f"_h_n_{c}", f"_w{h}_n_{c}"
    mh, mw = f"coalesce(_h_m_{c}, 0D)", f"coalesce(_w{h}_m_{c}, 0D)"
    if stat == "mean":
        return f"({mh} * {nh} + {mw} * {nw}) / nullif({nh} + {nw}, 0)"
    between = f"({mh} - {mw}) * ({mh} - {mw}) * {nh} * {nw} / nullif({nh} + {nw}, 0)"
    within = f"coalesce(_h_v_{c}, 0D) * {nh} + _w{h}_v_{c}"
    return f"CASE WHEN {nh} + {nw} > 1 THEN sqrt(({within} + {between}) / ({nh} + {nw} - 1)) END"


def _picked(rows: DataFrame, pairs) -> DataFrame:
    """Add ``_at_<h>_<tol>``: struct of the row nearest to ``h`` hours ago, null if none is close;
    the earlier of two that are equally far."""
    ends = [x for i in range(len(pairs)) for x in (f"coalesce(_b{i}, _last_{i}) AS _before{i}", f"coalesce(_a{i}, _first_{i}) AS _after{i}")]
    picks = []
    for i, ((hours, tol), cols) in enumerate(pairs.items()):
        lag, reach = hours * US_PER_HOUR, tol * 60_000_000
        b, a = f"_before{i}", f"_after{i}"
        behind, ahead = f"{US} - {lag}L - {b}.us", f"{a}.us - ({US} - {lag}L)"
        side = lambda x: "named_struct(" + ", ".join(f"'_v_{c}', {x}._v_{c}" for c in cols) + ")"
        picks.append(
            f"CASE WHEN {behind} <= {reach}L AND ({a} IS NULL OR {behind} <= {ahead}) THEN {side(b)} "
            f"WHEN {ahead} <= {reach}L THEN {side(a)} END AS _at_{hours}_{tol}"
        )
    return rows.selectExpr("*", *ends).selectExpr("*", *picks)


# --- row-to-row operators ------------------------------------------------------------


def padded_change(column: str) -> Column:
    """Relative change against the last known value; infinities become null."""
    prev = F.col(f"_prev_{column}")
    return F.when(prev != 0, F.coalesce(F.col(column), prev) / prev - 1)


def pct_change(df: DataFrame, cols: dict[str, str], keys: Sequence[str] = KEYS, **kw) -> DataFrame:
    """Relative change against the previous row, gaps padded forward."""
    known = carried(df, list(dict.fromkeys(cols.values())), keys, **kw)
    return known.select(*df.columns, *[padded_change(c).alias(name) for name, c in cols.items()])


def keeps_nulls(column: str) -> bool:
    """Columns in which a null is information, never a gap to fill."""
    return any(p in column for p in ("lag_", "rolling_", "change_rate"))


def fill_gaps(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
    backward: bool = True,
    default: float | None = 0.0,
    time: str = TIME,
    seq: str = SEQ,
) -> DataFrame:
    """Forward fill, then backward fill, then a default; all but lag, rolling and change columns.

    ``backward`` looks into the future, so leave it off for anything incremental.
    """
    if cols is None:
        cols = [c for c in df.columns if c not in {*keys, time, seq} and not keeps_nulls(c)]
    out = carried(df, cols, keys, ahead=backward, time=time, seq=seq)

    def filled(c: str) -> Column:
        options = [F.col(c), F.col(f"_prev_{c}")] + ([F.col(f"_next_{c}")] if backward else [])
        if default is not None:
            options.append(F.lit(default).cast(df.schema[c].dataType))
        return F.coalesce(*options).alias(c)

    return out.select(*[filled(c) if c in cols else F.col(c) for c in df.columns])


def shift(
    df: DataFrame,
    cols: dict[str, tuple[str, int]],
    keys: Sequence[str] = KEYS,
    time: str = TIME,
    seq: str | None = SEQ,
    pos: str | None = None,
) -> DataFrame:
    """Row shifts: ``{name: (column, k)}``, k > 0 looks back, k < 0 ahead.

    Rows are numbered first and cut by position, so one long station spreads over many
    tasks. ``pos`` names an existing position column and saves the numbering.
    """
    src = df if pos else with_position(df, keys, "_pos", time=time, seq=seq)
    p = pos or "_pos"
    back = max([k for _, k in cols.values()] + [0])
    ahead = max([-k for _, k in cols.values()] + [0])
    cut = position_halo(src, back, ahead, p)
    w = piece_window(keys).orderBy(p)
    out = cut.select("*", *[F.lag(c, k).over(w).alias(name) for name, (c, k) in cols.items()])
    return core(out).select(*df.columns, *cols)


def time_gaps(
    df: DataFrame, min_hours: float = 2.0, keys: Sequence[str] = KEYS, time: str = TIME, **kw
) -> DataFrame:
    """Stretches of more than ``min_hours`` without a reading."""
    prev = carried(df, [time], keys, time=time, **kw)
    start, end = F.col(f"_prev_{time}"), F.col(time)
    hours = (F.unix_micros(end) - F.unix_micros(start)) / US_PER_HOUR
    return prev.filter(hours > min_hours).select(
        *keys, start.alias("gap_start"), end.alias("gap_end"), hours.alias("gap_hours")
    )


def dedupe_last(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the last row per key. An aggregate, so copies of a hot key shrink before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    kept = df.groupBy(*by).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return kept.select(*[F.col(c) if c in by else F.col(f"_row.{c}") for c in df.columns])
