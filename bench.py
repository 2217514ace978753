"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the test tables, BENCH_CPUS the local cores. Each query runs to completion
through the ``noop`` sink, which computes every column and keeps nothing.
"""

from __future__ import annotations

import json
import os
import time

from lanewise import build_session
from lanewise.catalog import QUERIES

HEADLINES = [
    "src_01_load_slice",
    "snk_01_obs_by_city_zone",
    "flt_01_clean_obs",
    "flt_06_eligible_streets",
    "joi_01_asof_nearest",
    "joi_01_asof_scores",
    "agg_01_hourly_mean",
    "agg_02_daily_sum_of_years",
    "agg_03_weekly_sum",
    "agg_04_monthly_sum_of_years",
    "agg_05_hourly_profile",
    "agg_06_congested_slots",
    "agg_07_congested_slots_by_slug",
    "agg_09_weekly_pattern",
    "agg_10_slot_means",
    "agg_14_volume_by_zone",
    "agg_17_series_summary",
    "agg_20_day_summary",
    "met_03_daily_metrics",
    "met_07_top_models_by_smape",
    "scl_07_slug",
    "scl_12_traffic_level",
    "win_02_interpolate_both",
    "win_04_sequence_windows",
    "win_06_congestion_windows",
    "win_07_value_windows",
    "fc_03_batch_forecast",
    "fc_05_ar1",
    "fc_09_rollout_strict",
    "fc_11_week_ahead",
    "fc_12_daily_actual_vs_models",
    "fc_13_backtest_top_models",
    "fc_08_train_logit",
    "fc_16_departure_morning",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINES
    spark = build_session(
        f"local[{cpus}]",
        "lanewise-bench",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    QUERIES["agg_01_hourly_mean"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
