"""The command line, from raw files to stored results."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lanewise import jobs
from lanewise.sources import artifacts, observations


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """An interstate feed and a bridge feed of three weeks, with an hour missing now and then."""
    folder = tmp_path_factory.mktemp("feeds")
    rng = random.Random(1)
    hours = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(24 * 21)]
    level = lambda h: 1000 + 500 * (h.hour in range(7, 19)) + rng.randrange(40)
    (folder / "i.csv").write_text(
        "date_time,traffic_volume\n" + "".join(f"{h},{level(h)}\n" for h in hours if rng.random() > 0.02)
    )
    (folder / "b.csv").write_text(
        "Date,Fremont Bridge Total,Fremont Bridge East Sidewalk\n"
        + "".join(f"{h},{level(h)},{level(h) // 2}\n" for h in hours)
    )
    table = str(folder / "obs")
    jobs.main(
        ["ingest-interstate", "--csv", f"{folder}/i.csv", "--root", table, "--city", "Minneapolis", "--zone", "I94", "--hourly"],
        spark,
    )
    jobs.main(
        ["ingest-bridge", "--csv", f"{folder}/b.csv", "--root", table, "--city", "Seattle", "--zone", "FremontBridge"], spark
    )
    return table


def test_ingest(spark, root):
    rows = observations.load_all(spark, root)
    assert {tuple(r) for r in rows.select("City", "Zone", "RouteId").distinct().collect()} == {
        ("Minneapolis", "I94", "I-94-WB"),
        ("Seattle", "FremontBridge", "Fremont-Total"),
        ("Seattle", "FremontBridge", "Fremont-East"),
    }


def test_precompute_daily(spark, root, tmp_path):
    out = str(tmp_path / "daily")
    jobs.main(["precompute-daily", "--root", root, "--out", out, "--days-back", "9"], spark)
    cache = artifacts.read_daily_cache(spark, out)
    assert cache.count() == 3 * 10
    assert {r[0] for r in cache.select("family").distinct().collect()} == {"I94", "Seattle_FremontBridge"}
    assert cache.where("Daily_seasonal_naive IS NULL OR Daily_sar1 IS NULL").count() == 0
    jobs.main(["precompute-daily", "--root", root, "--out", out, "--days-back", "3"], spark)
    assert artifacts.read_daily_cache(spark, out).count() == 3 * 10
    jobs.main(
        ["precompute-daily", "--root", root, "--out", out, "--days-back", "3", "--city", "Seattle", "--overwrite"], spark
    )
    assert artifacts.read_daily_cache(spark, out).count() == 10 + 2 * 4


def test_backtest(spark, root, tmp_path):
    out = str(tmp_path / "bt")
    jobs.main(["backtest", "--root", root, "--out", out, "--days", "8", "--no-arima"], spark)
    summary = artifacts.read_backtest_summaries(spark, f"{out}/summary", multi_line=False).collect()
    assert {r["route_id"]: r["family_name"] for r in summary} == {
        "I-94-WB": "I94", "Fremont-Total": "Seattle_FremontBridge", "Fremont-East": "Seattle_FremontBridge"
    }
    for row in summary:
        assert len(row["top_models"]) == 2 and "ar1" not in row["metrics_avg"]
        assert row["n_days_evaluated"] == 7
        scores = {m: s["score"] for m, s in row["metrics_avg"].items()}
        assert row["top_models"] == sorted(scores, key=lambda m: (scores[m], m))[:2]


def test_backtest_of_one_route(spark, root, tmp_path):
    out = str(tmp_path / "one")
    jobs.main(
        ["backtest", "--root", root, "--out", out, "--days", "5", "--city", "Seattle", "--zone", "(All)",
         "--route", "Fremont-East", "--models", "profile"], spark
    )
    assert {r[0] for r in spark.read.parquet(f"{out}/daily_metrics").select("RouteId").distinct().collect()} == {"Fremont-East"}


def test_predict(spark, root, tmp_path):
    out = str(tmp_path / "p")
    jobs.main(["predict", "--root", root, "--out", out], spark)
    got = artifacts.read_predictions(spark, out)
    assert got.count() == 3 * 21 * 24
    late = got.where(F.col("BaseDate") >= "2024-01-10")
    assert {r[0] for r in late.select("ModelUsed").distinct().collect()} == {"seasonal_naive"}


def test_predict_with_a_fitted_model(spark, root, tmp_path):
    out = str(tmp_path / "p")
    jobs.main(["predict", "--root", root, "--out", out, "--model", "linear"], spark)
    got = artifacts.read_predictions(spark, out)
    assert got.count() == 3 * 21 * 24
    assert {r[0] for r in got.where(F.col("BaseDate") == "2024-01-20").select("ModelUsed").distinct().collect()} == {"linear"}
    assert got.where(F.col("PredictedVehicles").isNull() | (F.col("PredictedVehicles") < 0)).count() == 0


def test_street_jobs(spark, tmp_path):
    start = dt.datetime(2021, 3, 1)
    lines = ["_id,segment_id,date,period,LOS,street_name"]
    for name in ("Lý Thường Kiệt", "Lê Đức Thọ"):
        for i in range(120):
            at = start + dt.timedelta(minutes=30 * i)
            letter = "E" if (i // 4) % 2 else "A"
            lines.append(f"{i},1,{at.date()},period_{at.hour}_{at.minute},{letter},{name}")
    (tmp_path / "s.csv").write_text("\n".join(lines))
    out = str(tmp_path / "streets")
    jobs.main(["train-streets", "--csv", f"{tmp_path}/s.csv", "--out", out], spark)
    registry = spark.read.parquet(f"{out}/registry/logit").collect()
    assert {r["slug"]: r["status"] for r in registry} == {"ly_thuong_kiet": "trained", "le_duc_tho": "trained"}
    assert spark.read.parquet(f"{out}/models/logit").count() == 2
    jobs.main(["evaluate-streets", "--csv", f"{tmp_path}/s.csv", "--out", out, "--models", "logit"], spark)
    details = spark.read.option("header", "true").csv(f"{out}/details")
    assert {r[0] for r in details.select("slug").distinct().collect()} == {"ly_thuong_kiet", "le_duc_tho"}
