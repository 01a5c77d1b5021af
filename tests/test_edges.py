"""Hand-made frames for the corner cases, with expected values worked out by hand or brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from breezeframe.functions import aqi as A
from breezeframe.functions import features as X
from breezeframe.operators import aggregates as G
from breezeframe.operators import analytics as T
from breezeframe.operators import frames as R
from breezeframe.operators import windows as W
from breezeframe.operators.joins import align_offset_join
from breezeframe.operators.layout import pick_chunk_hours, with_position
from breezeframe.operators.quantiles import exact_quantiles
from breezeframe.operators.shaping import cast_schema, iqr_filter_seq
from breezeframe.session import scratch_path
from breezeframe.sources import store, tables


def column(df, name, order="seq"):
    return [r[name] for r in df.orderBy(order).collect()]


def lag(df, hours=1, tol=30, **kw):
    return column(W.asof_lag(df, "v", hours, tol, "lag", **kw), "lag")


def test_lag_tie_takes_earlier(series):
    df = series([("s", "09:50", 1, 1.0), ("s", "10:10", 2, 2.0), ("s", "11:00", 3, 9.0)])
    assert lag(df)[2] == 1.0


def test_lag_duplicate_time_takes_first_stored(series):
    df = series([("s", "10:00", 2, 7.0), ("s", "10:00", 1, 5.0), ("s", "11:00", 3, 9.0)])
    assert lag(df)[2] == 5.0


def test_lag_nearest_null_stays_null(series):
    df = series([("s", "09:55", 1, 1.0), ("s", "10:00", 2, None), ("s", "11:00", 3, 9.0)])
    assert lag(df)[2] is None


@pytest.mark.parametrize("minutes", [30, 45, 50, 60])
def test_lag_tolerance_ends_are_inside(series, minutes):
    df = series([("s", f"09:{60 - minutes:02d}", 1, 4.0), ("s", "11:00", 2, 9.0)])
    assert lag(df, 1, minutes)[1] == 4.0
    assert lag(df, 1, minutes - 1)[1] is None


def test_lag_and_rolling_do_not_depend_on_chunk_width(spark, series):
    rng = np.random.default_rng(3)
    minutes = np.sort(rng.integers(0, 60 * 24 * 9, 400))
    rows = [
        (("a", "b")[i % 2], f"2024-01-{1 + m // 1440:02d} {m % 1440 // 60:02d}:{m % 60:02d}:00", i, float(rng.integers(0, 9)) if i % 7 else None)
        for i, m in enumerate(minutes.tolist())
    ]
    df = series(rows)
    kw = dict(lags=[W.Lag("l", "v", 24)], rolls=[W.Rolling("r", "v", 6, "std"), W.Rolling("m", "v", 6, "max")])
    wide = W.window_features(df, chunk_hours=24 * 40, **kw).orderBy("seq").collect()
    assert W.window_features(df, chunk_hours="auto", **kw).count() == 400
    narrow = W.window_features(df, chunk_hours=5, **kw).orderBy("seq").collect()
    for a, b in zip(wide, narrow):
        assert (a.l, a.m) == (b.l, b.m)
        assert (a.r is None and b.r is None) or a.r == pytest.approx(b.r, abs=1e-9)


def test_rolling_brute_force(series):
    rng = np.random.default_rng(5)
    minutes = np.sort(rng.integers(0, 2880, 150)).tolist()
    rows = [("s", f"2024-01-{1 + m // 1440:02d} {m % 1440 // 60:02d}:{m % 60:02d}:00", i, float(rng.integers(0, 50)) if i % 5 else None) for i, m in enumerate(minutes)]
    df = W.window_features(series(rows), rolls=[W.Rolling(s, "v", 3, s) for s in ("mean", "std", "min", "max")])
    got = {r.seq: r for r in df.collect()}
    for _, _, i, _ in rows:
        inside = [x for (_, _, j, x), m in zip(rows, minutes) if minutes[i] - 180 <= m <= minutes[i]]
        known = [x for x in inside if x is not None]
        r = got[i]
        if len(inside) < 2 or not known:
            assert r.mean is None and r.max is None
            continue
        assert r.mean == pytest.approx(np.mean(known)) and r.min == min(known) and r.max == max(known)
        if len(known) > 1:
            assert r.std == pytest.approx(np.std(known, ddof=1), abs=1e-9)
        else:
            assert r.std is None


def test_rolling_needs_two_rows_and_counts_null_rows(series):
    df = series([("s", "10:00", 1, 5.0), ("s", "20:00", 2, None), ("s", "20:30", 3, 4.0)])
    out = W.window_features(df, rolls=[W.Rolling("m", "v", 3, "mean"), W.Rolling("d", "v", 3, "std")])
    assert column(out, "m") == [None, None, 4.0]
    assert column(out, "d") == [None, None, None]


def _dense(series, n=1500):
    rng = np.random.default_rng(11)
    seconds = np.sort(rng.integers(0, 40 * 3600, n)).tolist()
    at = lambda x: f"2024-01-{1 + x // 86400:02d} {x % 86400 // 3600:02d}:{x % 3600 // 60:02d}:{x % 60:02d}"
    return seconds, series([("s", at(x), i, float(rng.integers(0, 50)) if i % 5 else None) for i, x in enumerate(seconds)])


def _largest_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_windows_spread_a_dense_series(series, monkeypatch):
    """One station within one week is many tasks, each of a bounded size."""
    from breezeframe.operators import layout

    monkeypatch.setattr(layout, "TASK_ROWS", 200, raising=False)
    monkeypatch.setattr(W, "BUCKET_ROWS", 20, raising=False)
    _, df = _dense(series)
    out = W.window_features(df, lags=[W.Lag("l", "v", 24)], rolls=[W.Rolling("m", "v", 24, "mean")])
    assert _largest_task(out) <= 300


def test_fills_spread_a_dense_series(series, monkeypatch):
    from breezeframe.operators import layout

    monkeypatch.setattr(layout, "TASK_ROWS", 60, raising=False)
    _, df = _dense(series)
    out = layout.carried(df, ["v"], ahead=True, bucket_hours=1)
    assert out.count() == 1500 and out.rdd.getNumPartitions() >= 25 and _largest_task(out) <= 300


@pytest.mark.parametrize("chunk_hours, bucket_rows", [(168, 20_000), (0.15, 20_000), ("auto", 30)])
def test_narrow_buckets_brute_force(series, monkeypatch, chunk_hours, bucket_rows):
    monkeypatch.setattr(W, "BUCKET_ROWS", bucket_rows, raising=False)
    seconds, df = _dense(series, 700)
    stats = ("mean", "std", "min", "max")
    rolls = [W.Rolling(f"{s}{h}", "v", h, s) for s in stats for h in (1, 3, 24)]
    lags = [W.Lag("l1", "v", 1, 2), W.Lag("l24", "v", 24, 60)]
    got = W.window_features(df, lags=lags, rolls=rolls, chunk_hours=chunk_hours).orderBy("seq").collect()
    v = [r.v for r in got]
    for i, r in enumerate(got):
        for h, tol, name in ((1, 2, "l1"), (24, 60, "l24")):
            far = [(abs(x - seconds[i] + h * 3600), x, j) for j, x in enumerate(seconds) if abs(x - seconds[i] + h * 3600) <= tol * 60]
            assert r[name] == (v[min(far)[2]] if far else None)
        for h in (1, 3, 24):
            inside = [j for j, x in enumerate(seconds) if seconds[i] - h * 3600 <= x <= seconds[i]]
            known = [v[j] for j in inside if v[j] is not None]
            if len(inside) < 2 or not known:
                assert r[f"mean{h}"] is None and r[f"min{h}"] is None and r[f"max{h}"] is None
                continue
            assert (r[f"min{h}"], r[f"max{h}"]) == (min(known), max(known))
            assert r[f"mean{h}"] == pytest.approx(np.mean(known))
            assert r[f"std{h}"] == (pytest.approx(np.std(known, ddof=1), abs=1e-9) if len(known) > 1 else None)


def test_change_rate_null_on_zero(series):
    df = series([("s", "10:00", 1, 0.0), ("s", "11:00", 2, 5.0), ("s", "12:00", 3, 10.0)])
    assert column(W.window_features(df, changes=[W.Change("c", "v", 1)]), "c") == [None, None, 1.0]


def test_pct_change_pads_forward_over_buckets(series):
    df = series([("s", "2024-01-01 10:00:00", 1, 2.0), ("s", "2024-01-03 10:00:00", 2, None), ("s", "2024-01-06 10:00:00", 3, 3.0)])
    assert column(W.pct_change(df, {"c": "v"}), "c") == [None, 0.0, 0.5]


def test_fill_reaches_across_empty_buckets(series):
    df = series([("s", "2024-01-01 10:00:00", 1, None), ("s", "2024-01-04 10:00:00", 2, 3.0), ("s", "2024-01-09 10:00:00", 3, None), ("t", "10:00", 4, None)])
    assert column(W.fill_gaps(df), "v") == [3.0, 3.0, 3.0, 0.0]
    assert column(W.fill_gaps(df, backward=False, default=None), "v") == [None, 3.0, 3.0, None]


def test_position_across_buckets(series):
    rows = [("s", f"2024-01-{1 + i:02d} 10:00:00", i, 1.0) for i in range(20)]
    out = with_position(series(rows), total="n", bucket_hours=48)
    assert column(out, "pos") == list(range(1, 21)) and column(out, "n") == [20] * 20


def test_pick_chunk_hours(series):
    df = series([("s", "10:00", i, 1.0) for i in range(10)])
    assert pick_chunk_hours(df, reach_hours=2, target_rows=5) == 12.0
    assert pick_chunk_hours(df, reach_hours=73, target_rows=1) == 36.5


def test_aqi_gaps(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([12.0, 12.05, 12.1, -1.0, 604.5, None])], "i int, c double")
    c = F.col("c")
    strict = [r[0] for r in df.orderBy("i").select(A.aqi_strict(c, "pm2_5")).collect()]
    clamped = [r[0] for r in df.orderBy("i").select(A.aqi_clamped(c, "pm2_5")).collect()]
    zero = [r[0] for r in df.orderBy("i").select(A.aqi_analysis(c, "pm2_5")).collect()]
    assert strict == [50, None, 51, None, None, None]
    assert clamped == [50, 50, 51, 0, 500, None]
    assert zero == [50, 0, 51, 0, 0, 0]


def test_aqi_half_to_even(spark):
    # PM10 0..54 maps to 0..50: 0.54 -> 0.5 and 1.62 -> 1.5
    df = spark.createDataFrame([(0.54,), (1.62,)], "c double")
    assert [r[0] for r in df.select(A.aqi_strict(F.col("c"), "pm10")).collect()] == [0, 2]


def test_sql_functions_agree_with_columns(spark):
    A.register_sql_functions(spark)
    df = spark.range(0, 6000).selectExpr("id / 10.0D as c")
    bad = df.filter(
        ~F.expr("aqi_pm25(c)").eqNullSafe(A.aqi_strict(F.col("c"), "pm2_5"))
        | ~F.expr("aqi_category(aqi_pm10(c))").eqNullSafe(A.aqi_category(A.aqi_strict(F.col("c"), "pm10")))
    )
    assert bad.count() == 0


def test_exact_quantiles_on_skewed_values(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(700, 3.0), rng.lognormal(0, 4, 1500), [-1e12, 1e12]])
    df = spark.createDataFrame([("s", float(v)) for v in values], "station string, v double")
    got = {r.p: r.value for r in exact_quantiles(df, ["v"], [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for p, v in got.items():
        assert v == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_iqr_is_sequential(spark):
    rows = [("s", float(i), float(i)) for i in range(10)] + [("s", 1000.0, 5.0), ("s", 5.0, None)]
    df = spark.createDataFrame(rows, "station string, a double, b double")
    kept = [r.a for r in iqr_filter_seq(df, ["a", "b"]).collect()]
    assert sorted(kept) == [float(i) for i in range(10)]


def test_mode_keeps_ties(spark):
    df = spark.createDataFrame([("s", x) for x in (3, 3, 1, 1, 2)], "station string, v int")
    assert {(r.v, r.is_smallest) for r in G.mode_of(df, "v").collect()} == {(1, True), (3, False)}


def test_group_stats_two_digits(spark):
    df = spark.createDataFrame([("s", "N", 1.006), ("s", "E", 2.0)], "station string, d string, v double")
    r = {x.d: x for x in G.group_stats(df, "d", "v").collect()}
    assert r["N"]["mean"] == 1.01 and r["N"].highest == "E" and r["N"].lowest == "N"


def test_offset_defaults_to_zero_without_overlap(spark):
    w = spark.sql("select 's' station, 1 step_hour, timestamp'2024-01-01 05:00:00' target_time, 1D temperature")
    p = spark.sql("select 's' station, 9 step_hour, timestamp'2024-01-01 05:00:00' target_time, 2D ozone")
    assert align_offset_join(w, p).collect()[0].ozone is None


def test_pacf_matches_least_squares(spark, series):
    rng = np.random.default_rng(2)
    x = [0.0]
    for e in rng.normal(size=119):
        x.append(0.6 * x[-1] + float(e))
    df = series([("s", f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00", i, v) for i, v in enumerate(x)])
    got = [r.r for r in T.pacf(df, "v", 6).orderBy("lag").collect()]
    x = np.array(x)
    for k in range(1, 7):
        m = np.column_stack([x[k - j : len(x) - j] for j in range(1, k + 1)] + [np.ones(len(x) - k)])
        assert got[k] == pytest.approx(np.linalg.lstsq(m, x[k:], rcond=None)[0][k - 1], abs=1e-8)


def test_chi2_tail(spark):
    # 5% points of the chi-square distribution
    points = {1: 3.841459, 2: 5.991465, 3: 7.814728, 5: 11.070498, 10: 18.307038, 23: 35.172462, 24: 36.415029}
    df = spark.createDataFrame([(k, q) for k, q in points.items()], "k int, q double")
    for r in df.select("k", T.chi2_tail(F.col("q"), F.col("k")).alias("p")).collect():
        assert r.p == pytest.approx(0.05, abs=1e-6), r.k


def test_ar1_noise_repeats_and_has_the_asked_spread(spark):
    df = spark.range(4000).selectExpr("'s' station", "timestamp_seconds(id * 3600) time", "array_repeat(0D, 72) x")
    one = R.ar1_noise(df, ["x"], 0.05, 0.3, 72)
    two = R.ar1_noise(df.repartition(7), ["x"], 0.05, 0.3, 72)
    assert one.exceptAll(two).count() == 0
    first, last = one.agg(F.stddev(F.col("x")[0]), F.stddev(F.col("x")[71])).first()
    steps = np.linspace(0.05, 0.3, 72)
    want = np.sqrt(sum((0.8 ** (71 - i) * s) ** 2 for i, s in enumerate(steps)))
    assert first == pytest.approx(0.05, rel=0.06) and last == pytest.approx(want, rel=0.06)


def test_upsert_is_idempotent_and_empty_is_noop(spark, series):
    path = scratch_path(spark, "t")
    df = series([("s", "10:00", 1, 1.0), ("s", "11:00", 2, 2.0)])
    assert store.upsert_features(df.filter("seq > 5"), path)
    for _ in range(2):
        store.upsert_features(df, path)
    store.upsert_features(df.filter("seq = 2").withColumn("v", F.lit(9.0)), path)
    assert {(r.time_str[11:13], r.v) for r in store.read_table(spark, path).collect()} == {("10", 1.0), ("11", 9.0)}


def test_lookup_fails_on_missing_hour(spark, series):
    df = series([("s", "10:00", 1, 1.0), ("s", "12:00", 2, 2.0)])
    anchors = df.filter("seq = 2").selectExpr("station", "time as anchor")
    with pytest.raises(Exception, match="no row for hour 2024-01-01 11:00:00"):
        tables.lookup_hours(df, anchors, 3, forward=False).collect()
    assert tables.lookup_hours(df, anchors, 3, forward=False, strict=False).count() == 2


def test_missing_table_reads_empty(spark):
    from pyspark.sql import types as T_

    schema = T_.StructType([T_.StructField("time", T_.TimestampType())])
    assert tables.read_features(spark, scratch_path(spark, "none"), schema).count() == 0


def test_require(spark):
    with pytest.raises(ValueError, match="pm10"):
        tables.require(spark.range(1), ["id", "pm10"])
    with pytest.raises(Exception, match="rows: 3 expected: 4"):
        tables.require_rows(spark.range(3).selectExpr("'s' station", "id"), 4).collect()


def test_cast_schema_keeps_flags_integral(spark):
    out = cast_schema(spark.sql("select 1 is_hot, 2 hour, 'x' city, 3L seq"))
    assert dict(out.dtypes) == {"is_hot": "bigint", "hour": "double", "city": "string", "seq": "bigint"}


def test_template_and_interaction_names():
    assert [X.base_from_template(t) for t in ("a_target_{h}h", "a_target_hh", "a_target_12h", "a")] == ["a"] * 4
    assert X.split_interaction("pm10_wind_speed_interaction") == ("pm10", "wind_speed")


def test_no_window_runs_on_a_single_partition(spark):
    """Nothing in the feature plan may order all rows on one task."""
    from breezeframe.catalog import load_all

    queries, _ = load_all()
    for name in ("e1_clean_features", "w10_fill_gaps", "w8_targets", "t7_acf"):
        plan = queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan, name


def test_all_windows_share_one_exchange(spark, series):
    df = series([("s", "10:00", 1, 1.0)])
    out = W.window_features(df, lags=W.target_lags(["v"]), rolls=W.target_rolling(["v"]), changes=W.target_changes(["v"]))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    full = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and full.count("Exchange hashpartitioning") == 1


# --- late, doubled and absent rows ---------------------------------------------------


def test_ingest_keeps_late_deliveries_and_the_last_row(spark, tmp_path):
    from breezeframe.streaming import jobs

    doc = lambda dt, v: f'{{"list":[{{"dt":{dt},"components":{{"pm2_5":{v}}}}}]}}'
    hours = [100, 0, 50, 100, 3]
    for n, h in enumerate(hours):
        rows = [("s", doc(1704067200 + 3600 * h, float(n)))]
        spark.createDataFrame(rows, "station string, payload string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for run in ("a", "b"):  # a new checkpoint replays everything
        stream = jobs.read_documents(spark, f"{tmp_path}/in", files_per_batch=1)
        jobs.run_updates(stream, jobs.hourly_ingest(f"{tmp_path}/out"), f"{tmp_path}/ckpt-{run}")
        got = {r["time"].isoformat(): r["pm2_5"] for r in store.read_table(spark, f"{tmp_path}/out").collect()}
        assert len(got) == 4 and sorted(got.values()) == [1.0, 2.0, 3.0, 4.0]


def test_updates_reach_as_far_as_the_features(spark, series, tmp_path):
    from breezeframe.operators.windows import Lag, window_features
    from breezeframe.streaming import jobs

    rows = [("s", f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00", h, float(h)) for h in range(0, 400, 4)]
    df = series(rows, "pm2_5").drop("seq")
    lags = [Lag("week", "pm2_5", 168)]
    for flag in (False, True):
        part = df.where(F.pmod(F.col("pm2_5"), F.lit(12)) == 0) if flag else df.where(F.pmod(F.col("pm2_5"), F.lit(12)) != 0)
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    handler = jobs.feature_updates(f"{tmp_path}/raw", f"{tmp_path}/out", lags, columns=["pm2_5"])
    jobs.run_updates(stream, handler, f"{tmp_path}/ckpt")
    want = window_features(df.withColumn("seq", F.unix_seconds("time")), lags)
    key = lambda d: sorted((r["time"], r["week"]) for r in d.collect() if r["week"] is not None)
    assert key(store.read_table(spark, f"{tmp_path}/out")) == key(want) and len(key(want)) > 30


def test_long_model_fills_missing_short_steps(spark):
    from breezeframe.operators.evaluate import merge_metrics

    make = lambda hs: spark.createDataFrame([("s", h, "t", float(h)) for h in hs], "station string, h int, target string, rmse double")
    assert sorted(r["h"] for r in merge_metrics(make([1]), make([1, 6, 24])).collect()) == [1, 6, 24]


def test_equal_times_do_not_multiply_training_rows(spark, series):
    from breezeframe.plans.forecasts import training_frame

    rows = [("s", f"{h // 2:02d}:00", h, float(h % 7)) for h in range(10)]
    df = series(rows, "pm2_5").withColumn("pm10", F.col("pm2_5") * 2)
    assert training_frame(df, [1]).count() == 20


def test_strict_lookup_rejects_doubled_hours(spark, series):
    from breezeframe.sources import tables

    df = series([("s", "00:00", 0, 1.0), ("s", "01:00", 1, 2.0), ("s", "01:00", 2, 3.0)])
    anchors = spark.sql("SELECT 's' AS station, timestamp'2024-01-01 00:00:00' AS anchor")
    with pytest.raises(Exception, match="several rows"):
        tables.lookup_hours(df, anchors, 1, forward=True).collect()


def test_require_rows_sees_absent_keys(spark):
    from breezeframe.sources import tables

    known = spark.sql("SELECT 's' AS station")
    none = spark.createDataFrame([], "station string, v int")
    with pytest.raises(Exception, match="rows: 0 expected: 3"):
        tables.require_rows(none, 3, known=known).collect()
    three = spark.range(3).selectExpr("'s' AS station", "int(id) AS v")
    assert tables.require_rows(three, 3, known=known).count() == 3


def test_upsert_reads_only_the_touched_range(spark, series, tmp_path):
    from breezeframe.sources import store

    path = f"{tmp_path}/t"
    assert store.upsert_features(series([("s", f"2024-01-{d:02d} 00:00:00", d, 1.0) for d in range(1, 20)]), path)
    some = store.read_table(spark, path, "2024-01-05", "2024-01-06")
    assert len(some.inputFiles()) == 2 and some.count() == 2
    twice = series([("s", "2024-01-05 00:00:00", 1, 7.0), ("s", "2024-01-05 00:00:00", 2, 8.0)]).drop("seq")
    store.upsert_features(twice, path)
    first = store.read_table(spark, path).where("date = '2024-01-05'").first()["v"]
    store.upsert_features(twice.orderBy(F.desc("v")), path)
    again = store.read_table(spark, path).where("date = '2024-01-05'").collect()
    assert [r["v"] for r in again] == [first] and store.read_table(spark, path).count() == 19
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "notes.txt").write_text("not ours")
    with pytest.raises(ValueError, match="not a keyed table"):
        store.upsert_features(twice, f"{tmp_path}/bad")


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from breezeframe import session

    spark = lambda master: SimpleNamespace(
        conf=SimpleNamespace(get=lambda *a: None),
        sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda *a: None)),
    )
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(spark(master))
    assert session.shared_dir(spark("local[2]"))


def test_rejected_documents_are_listed(spark):
    from breezeframe.sources import payloads

    docs = spark.createDataFrame(
        [("a", '{"list":[{"dt":1,"components":{"co":1.0}}]}'), ("b", '{"list":[{"d'), ("c", "{}")], "station string, payload string")
    found = {r["station"]: r["reason"] for r in payloads.rejected_documents(docs).collect()}
    assert found == {"b": "malformed", "c": "no list"}


def test_quartile_filter_without_keys(spark):
    from breezeframe.operators.shaping import iqr_filter_seq

    df = spark.range(100).selectExpr("double(id) AS pm2_5", "double(if(id = 3, 1e6, id)) AS pm10")
    assert iqr_filter_seq(df, ["pm2_5", "pm10"], keys=()).count() == 99
