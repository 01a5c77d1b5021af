"""Keyed tables and the stream jobs on top of them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from breezeframe.session import scratch_path
from breezeframe.sources import payloads, store, tables
from breezeframe.streaming import jobs


def rows(spark, values, columns="x double"):
    made = [(s, f"2024-01-{d:02d} {h:02d}:00:00", *v) for s, d, h, *v in values]
    df = spark.createDataFrame(made, f"station string, t string, {columns}")
    return df.select("station", F.to_timestamp("t").alias("time"), *df.columns[2:])


def held(df, *columns):
    return {(r["station"], r["time"].day, r["time"].hour): tuple(r[c] for c in columns) for r in df.collect()}


def test_a_new_column_survives_later_upserts(spark):
    path = scratch_path(spark, "t")
    store.upsert_features(rows(spark, [("a", 1, 0, 1.0), ("a", 2, 0, 2.0)]), path)
    store.upsert_features(rows(spark, [("a", 1, 1, 3.0, 9.0)], "x double, y double"), path)
    store.upsert_features(rows(spark, [("a", 1, 2, 4.0), ("a", 1, 0, 5.0)]), path)
    want = {("a", 1, 0): (5.0, None), ("a", 2, 0): (2.0, None), ("a", 1, 1): (3.0, 9.0), ("a", 1, 2): (4.0, None)}
    assert held(store.read_table(spark, path), "x", "y") == want
    store.compact(spark, path)
    assert held(store.read_table(spark, path), "x", "y") == want
    assert held(tables.read_features(spark, path), "y")["a", 1, 1] == (9.0,)
    with pytest.raises(ValueError, match="column x is double, not string"):
        store.upsert_features(rows(spark, [("a", 1, 0, "z")], "x string"), path)
    with pytest.raises(ValueError, match="keyed by date"):
        store.upsert_rows(rows(spark, [("a", 1, 0, 1.0)]), path, "station", ["time"], ["time"])
    assert held(store.read_table(spark, path), "x", "y") == want


def test_readers_keep_their_version(spark):
    path = scratch_path(spark, "t")
    store.upsert_features(rows(spark, [("a", 1, 0, 1.0)]), path)
    before = store.read_table(spark, path)
    store.upsert_features(rows(spark, [("a", 1, 0, 2.0), ("b", 1, 0, 3.0)]), path)
    store.compact(spark, path)
    assert held(before, "x") == {("a", 1, 0): (1.0,)}
    assert held(store.read_table(spark, path), "x") == {("a", 1, 0): (2.0,), ("b", 1, 0): (3.0,)}
    assert held(store.read_table(spark, path, version=1), "x") == {("a", 1, 0): (1.0,)}
    assert store.versions(spark, path) == [1, 2, 3]
    assert store.vacuum(spark, path) == 2 and store.versions(spark, path) == [3]
    assert held(store.read_table(spark, path), "x") == {("a", 1, 0): (2.0,), ("b", 1, 0): (3.0,)}
    with pytest.raises(ValueError, match="no version 1"):
        store.read_table(spark, path, version=1)


def test_an_upsert_writes_only_its_own_rows(spark):
    path = scratch_path(spark, "t")
    store.upsert_features(rows(spark, [("a", d, h, 1.0) for d in range(1, 20) for h in range(24)]), path)
    store.upsert_features(rows(spark, [("a", 3, 5, 2.0)]), path)
    m = store.manifest_of(spark, path)
    last = m.folders["2024-01-03"][-1]
    assert spark.read.parquet(f"{path}/data/commit={last}").count() == 1
    assert [len(c) for v, c in sorted(m.folders.items())] == [1, 1, 2] + [1] * 16
    plan = store.read_table(spark, path, "2024-01-05", "2024-01-06")._jdf.queryExecution().toString()
    assert "Aggregate" not in plan  # nothing to merge there


def test_a_lost_race_is_tried_again(spark, monkeypatch):
    path = scratch_path(spark, "t")
    store.upsert_features(rows(spark, [("a", 1, 0, 1.0)]), path)
    publish, tries = store._Folder.publish, []

    def late(self, name, text):
        tries.append(name)
        if len(tries) == 1:  # another writer gets in between
            store.upsert_features(rows(spark, [("b", 1, 0, 2.0, 8.0)], "x double, z double"), path)
        return publish(self, name, text)

    monkeypatch.setattr(store._Folder, "publish", late)
    store.upsert_features(rows(spark, [("c", 1, 0, 3.0)]), path)
    got = held(store.read_table(spark, path), "x", "z")
    assert got == {("a", 1, 0): (1.0, None), ("b", 1, 0): (2.0, 8.0), ("c", 1, 0): (3.0, None)}
    assert len(tries) == 3 and store.versions(spark, path) == [1, 2, 3]


def test_compaction_keeps_what_comes_meanwhile(spark, monkeypatch):
    path = scratch_path(spark, "t")
    for n in range(3):
        store.upsert_features(rows(spark, [("a", 1, n, float(n)), ("a", 2, 0, float(n))]), path)
    write, once = store._write, []

    def slow(df, where, part):
        if not once:
            once.append(1)
            store.upsert_features(rows(spark, [("a", 1, 0, 7.0), ("a", 5, 0, 8.0)]), path)
        return write(df, where, part)

    monkeypatch.setattr(store, "_write", slow)
    store.compact(spark, path)
    want = {("a", 1, 0): (7.0,), ("a", 1, 1): (1.0,), ("a", 1, 2): (2.0,), ("a", 2, 0): (2.0,), ("a", 5, 0): (8.0,)}
    assert held(store.read_table(spark, path), "x") == want
    sizes = {v: len(c) for v, c in store.manifest_of(spark, path).folders.items()}
    assert sizes == {"2024-01-01": 2, "2024-01-02": 1, "2024-01-05": 1}


def test_many_upserts_equal_a_dictionary(spark):
    path, want, rnd = scratch_path(spark, "t"), {}, random.Random(2)
    for n in range(store.MOST_COMMITS + 4):
        batch = {("s" + str(rnd.randint(0, 2)), rnd.randint(1, 3), rnd.randint(0, 5)): (float(n),) for _ in range(8)}
        store.upsert_features(rows(spark, [(*k, *v) for k, v in batch.items()]), path)
        want.update(batch)
    assert held(store.read_table(spark, path), "x") == want
    assert max(map(len, store.manifest_of(spark, path).folders.values())) <= store.MOST_COMMITS


def test_rows_without_time_and_no_rows(spark):
    path = scratch_path(spark, "t")
    nothing = rows(spark, [("a", 1, 0, 1.0)]).where("x > 5")
    assert store.upsert_features(nothing, path) and not store.is_table(spark, path)
    with pytest.raises(FileNotFoundError):
        store.read_table(spark, path)
    store.upsert_features(rows(spark, [("a", 1, 0, 1.0)]).withColumn("time", F.lit(None).cast("timestamp")), path)
    store.upsert_features(rows(spark, [("a", 1, 0, 2.0)]), path)
    got = store.read_table(spark, path)
    assert got.count() == 2 and got.where("time IS NULL AND date IS NULL").count() == 1
    assert store.read_table(spark, path, "2024-01-01", "2024-01-01").count() == 1


def document(hour, **components):
    return json.dumps({"list": [{"dt": 1704067200 + 3600 * hour, "main": {"aqi": 2}, "components": components}]})


def test_ingest_loses_nothing(spark, tmp_path):
    batches = [
        [("a", document(0, pm2_5=1.0)), ("a", '{"list":[{"dt'), ("b", "{}")],
        [("a", document(1, pm2_5=2.0, xyz=5.0, time=3.0, Station=4.0)), ("b", document(0, pm10=1.0))],
        [("a", document(0, pm2_5=1.0)), ("a", '{"list":[{"dt'), ("b", None), ("b", '{"list":[{"main":{}}]}')],
    ]
    for n, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "station string, payload string").coalesce(1)
        df.write.mode("append").parquet(f"{tmp_path}/in")
    for run in "ab":  # the second run replays everything, under the same numbers
        stream = jobs.read_documents(spark, f"{tmp_path}/in", files_per_batch=1)
        jobs.run_updates(stream, jobs.hourly_ingest(f"{tmp_path}/out", f"{tmp_path}/bad"), f"{tmp_path}/ckpt-{run}")
        got = held(store.read_table(spark, f"{tmp_path}/out"), "pm2_5", "pm10", "xyz", "component_time", "component_Station")
        assert got == {
            ("a", 1, 0): (1.0, None, None, None, None), ("a", 1, 1): (2.0, None, 5.0, 3.0, 4.0), ("b", 1, 0): (None, 1.0, None, None, None),
        }
        bad = sorted((r["station"], r["reason"]) for r in jobs.rejected(spark, f"{tmp_path}/bad").collect())
        assert bad == [("a", "malformed"), ("a", "malformed"), ("b", "malformed"), ("b", "no list"), ("b", "no time")]


def test_documents_are_parsed_once(spark):
    docs = spark.createDataFrame([("a", document(0, pm2_5=1.0, xyz=2.0, bad="q")), ("b", "{")], "station string, payload string")
    plan = payloads.entries(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") <= 2 and "from_json" not in plan
    wide = payloads.flatten_pollution(docs, components="all").collect()
    assert [(r["pm2_5"], r["xyz"], r["bad"]) for r in wide] == [(1.0, 2.0, None)]
    rest = payloads.flatten_pollution(docs, components=["pm2_5"], others="more").first()
    assert rest["more"] == {"xyz": 2.0, "bad": None} and rest["openweather_aqi"] == 2


def test_windows_equal_plain_windows(spark):
    rnd = random.Random(7)
    hours = sorted({rnd.choice([0, 300, 2000]) + rnd.randint(0, 60) for _ in range(70)})
    data = [(s, h, float(rnd.randint(1, 99)) if rnd.random() < 0.9 else None) for s in "ab" for h in hours if rnd.random() < 0.8]
    df = spark.createDataFrame(data, "station string, h int, v double").selectExpr(
        "station", "timestamp_seconds(h * 3600 + 600) AS time", "v AS pm2_5", "v AS pm10")
    buckets = jobs.bucket_stats(df)
    got = {(r["station"], int(r["window_start"].timestamp()) // 3600): r for r in jobs.sliding_windows(buckets, per_window=24).collect()}
    want = {}
    for s, h, v in data:
        for start in range(h - 23, h + 1):
            want.setdefault((s, start), []).append(v)
    assert set(got) == set(want)
    for key, vs in want.items():
        vs = [v for v in vs if v is not None]
        r = got[key]
        assert (r["n"], r["pm2_5_min"], r["pm2_5_max"]) == (len(vs), min(vs, default=None), max(vs, default=None))
        assert r["pm2_5_mean"] == (pytest.approx(sum(vs) / len(vs)) if vs else None)
        assert (r["window_end"] - r["window_start"]).total_seconds() == 24 * 3600


def test_sliding_stream_takes_late_rows_and_replays(spark, tmp_path):
    make = lambda hs: spark.createDataFrame([("s", h, float(h)) for h in hs], "station string, h int, v double").selectExpr(
        "station", "timestamp_seconds(h * 3600) AS time", "v AS pm2_5", "v AS pm10").coalesce(1)
    for hs in ([0, 1, 5], [9, 30], [10, 30]):
        make(hs).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(make([0]).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    handler = jobs.keep_windows(f"{tmp_path}/hours", f"{tmp_path}/out")
    jobs.run_updates(jobs.bucket_stats(stream), handler, f"{tmp_path}/ckpt", "update")
    whole = {r["window_start"]: r["n"] for r in jobs.sliding_windows(jobs.bucket_stats(
        make([0, 1, 5, 9, 10, 30, 30]))).collect()}
    got = {r["window_start"]: r["n"] for r in store.read_table(spark, f"{tmp_path}/out").collect()}
    assert got == whole and max(got.values()) == 5
    plan = jobs.bucket_stats(make([0]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
