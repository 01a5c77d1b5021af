"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from breezeframe.catalog import load_all
from breezeframe.session import build_session

HEADLINE = [
    "e1_clean_features",
    "w1_tolerance_lags",
    "w3_rolling",
    "w5_change_rate",
    "w10_fill_gaps",
    "f1_aqi_strict",
    "j4_align_offset_join",
    "s1_flatten_pollution",
    "s14_upsert_features",
    "p13_iqr_filter_seq",
    "a1_describe",
    "a14_corr_matrix",
    "d7_quality_score",
    "t1_lead_lag_corr",
    "t7_acf",
    "w12_encoder_windows",
    "m6_horizon_metrics",
    "x1_hourly_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry, _ = load_all()
    # the first plan pays for class loading; it is not what is measured
    registry["e1_clean_features"](spark, sf_dir.rsplit("/", 1)[0] + "/sf0.001").write.format("noop").mode("overwrite").save()
    times = {}
    for name in chosen:
        start = time.perf_counter()
        registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rsplit("/sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
