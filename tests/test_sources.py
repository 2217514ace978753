"""Readers and writers on files that are odd, broken or absent."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lanewise import session
from lanewise.operators import windows
from lanewise.sources import artifacts, observations, raw


def test_interstate_csv(spark, tmp_path):
    path = tmp_path / "i.csv"
    path.write_text(
        "holiday,date_time,traffic_volume\nNone,2012-10-02 09:00:00,5545\nNone,bad,1\nNone,2012-10-02 10:00:00,\n"
    )
    got = raw.read_interstate(spark, str(path)).collect()
    assert [tuple(r) for r in got] == [(dt.datetime(2012, 10, 2, 9), "I-94-WB", 5545.0)]


def test_interstate_hourly_keeps_the_fourth_hour_empty(spark, tmp_path):
    path = tmp_path / "i.csv"
    path.write_text("date_time,traffic_volume\n2024-01-01 00:10:00,10\n2024-01-01 05:00:00,20\n")
    got = raw.read_interstate_hourly(spark, str(path)).orderBy("DateTime").collect()
    assert [r["Vehicles"] for r in got] == [10, 12, 14, 16, None, 20]


def test_csv_without_its_columns(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="lacks"):
        raw.read_interstate(spark, str(path))
    with pytest.raises(ValueError, match="lacks"):
        raw.read_level_of_service(spark, str(path))


def test_bridge_csv_skips_an_absent_column(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text(
        "Date,Fremont Bridge Total,Fremont Bridge East Sidewalk\n2012-10-03 00:00:00,13,4\n2012-10-03 01:00:00,10,\n"
    )
    got = raw.read_bridge(spark, str(path)).collect()
    assert sorted((r["RouteId"], r["Vehicles"]) for r in got) == [
        ("Fremont-East", 4.0), ("Fremont-Total", 10.0), ("Fremont-Total", 13.0)
    ]


def test_level_of_service_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text("_id,date,period,street_name,LOS\n1,2021-03-11,period_7_30,Lý Thường Kiệt,E\n2,2021-03-11,noon,X,A\n", encoding="utf-8-sig")
    got = raw.read_level_of_service(spark, str(path)).collect()
    assert [(r["street_name"], r["DateTime"]) for r in got] == [("Lý Thường Kiệt", dt.datetime(2021, 3, 11, 7, 30))]


def test_plain_folders_broken_and_foreign_files(spark, tmp_path):
    root = tmp_path / "ds"
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1), "r", 1.0)], "DateTime timestamp_ntz, RouteId string, Vehicles double")
    rows.write.parquet(f"{root}/Seattle/Bridge")
    rows.select("RouteId").write.parquet(f"{root}/Seattle/Other")
    (root / "Seattle" / "Bridge" / "broken.parquet").write_bytes(b"not parquet")
    got = observations.load_slice(spark, str(root), "Seattle", layout="plain", skip_broken=True).collect()
    assert len(got) == 1
    with pytest.raises(Exception, match="broken.parquet"):
        observations.load_slice(spark, str(root), "Seattle", layout="plain").collect()


@pytest.mark.parametrize("kind", ["int64", "text", "nanoseconds", "floats"])
def test_files_of_other_types_lose_no_row(spark, tmp_path, kind):
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq

    times = pd.date_range("2024-01-01", periods=48, freq="h")
    frame = pd.DataFrame({"DateTime": times, "RouteId": "r", "Vehicles": [float(k) for k in range(48)]})
    if kind == "int64":
        frame["Vehicles"], frame["RouteId"] = range(48), 7
    if kind == "text":
        frame["Vehicles"], frame["DateTime"] = frame["Vehicles"].astype(str), times.astype(str)
    folder = tmp_path / "ds" / "City=C" / "Zone=01"
    folder.mkdir(parents=True)
    table = pa.Table.from_pandas(frame)
    if kind == "nanoseconds":
        table = table.set_column(0, "DateTime", pa.array(times, pa.timestamp("ns")))
    if kind == "floats":
        table = table.set_column(2, "Vehicles", table["Vehicles"].cast(pa.float32()))
    pq.write_table(table, folder / "a.parquet", version="2.6")
    got = observations.load_all(spark, str(tmp_path / "ds")).orderBy("DateTime").collect()
    assert len(got) == 48 and got[5]["Vehicles"] == 5.0 and got[5]["DateTime"] == dt.datetime(2024, 1, 1, 5)
    assert got[0]["Zone"] == "01"


def test_metric_csv_is_read_by_header(spark, tmp_path):
    (tmp_path / "m.csv").write_text("slug,timesteps,street_name\nle_loi,90,Lê Lợi\n", encoding="utf-8")
    rows = artifacts.read_metric_csv(spark, f"{tmp_path}/m.csv")
    assert (rows.first()["street_name"], rows.first()["timesteps"], rows.first()["acc"]) == ("Lê Lợi", 90, None)
    assert artifacts.trained_configs(rows).count() == 1


def test_zones_that_look_like_numbers_stay_text(spark, tmp_path):
    rows = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1), "r", 1.0, "C", "01")],
        "DateTime timestamp_ntz, RouteId string, Vehicles double, City string, Zone string",
    )
    observations.write_observations(rows, f"{tmp_path}/o")
    assert observations.load_all(spark, f"{tmp_path}/o").first()["Zone"] == "01"


def test_absent_and_broken_artifacts(spark, tmp_path):
    assert artifacts.read_route_geo(spark, f"{tmp_path}/none.json").count() == 0
    assert artifacts.read_backtest_summaries(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "bad.json").write_text("{ not json")
    assert artifacts.read_backtest_summaries(spark, f"{tmp_path}/bad.json").count() == 0


def test_pretty_printed_json(spark, tmp_path):
    geo = [{"city": "Seattle", "zone": "Bridge", "route_id": "r", "lat": 47.6}]
    (tmp_path / "geo.json").write_text(json.dumps(geo, indent=2))
    got = artifacts.read_route_geo(spark, f"{tmp_path}/geo.json").first()
    assert (got["city"], got["lat"], got["lon"], got["name"]) == ("Seattle", 47.6, None, None)
    scores = dict(mse=1.0, rmse=1.0, mae=1.0, mape=1.0, smape=13.1, r2=0.9, score=13.1)
    summary = dict(city="M", zone="I94", route_id="r", family_name="I94", eval_start_date="2017-10-01",
                   eval_end_date="2018-09-29", n_days_evaluated=364, top_models=["A", "B"], metrics_avg={"A": scores})
    (tmp_path / "top.json").write_text(json.dumps(summary, indent=2))
    rows = artifacts.read_backtest_summaries(spark, f"{tmp_path}/top.json")
    assert artifacts.summary_scores(rows).first()["smape"] == 13.1


def test_scaler_is_fitted_once(spark, tmp_path):
    def base(value):
        return spark.createDataFrame([("r", value), ("r", value + 2)], "RouteId string, Vehicles double")

    first = artifacts.fit_once(spark, f"{tmp_path}/s", lambda: windows.fit_scaler(base(1.0)))
    second = artifacts.fit_once(spark, f"{tmp_path}/s", lambda: windows.fit_scaler(base(50.0)))
    assert tuple(first.first()) == tuple(second.first()) == (2.0, 1.0)


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert session.scratch_path(spark, "x").startswith(configured)
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_stored_table_keeps_schema_and_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string").withColumn("n", F.lit(None).cast("double"))
    kept = session.stored(df, "t")
    assert kept.schema.simpleString() == df.schema.simpleString()
    assert kept.exceptAll(df).count() == 0 and kept.count() == 2


def _write(path, **columns):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(columns), path)


def test_files_of_one_root_may_differ_in_type(spark, tmp_path):
    import pyarrow as pa

    root, times = tmp_path / "ds", [dt.datetime(2024, 1, 1, h) for h in range(3)]
    seconds = [int(t.replace(tzinfo=dt.timezone.utc).timestamp()) for t in times]
    _write(root / "City=A" / "Zone=1" / "a.parquet", DateTime=pa.array(times, pa.timestamp("us")), RouteId=["r"] * 3, Vehicles=[1.5, None, 3.0])
    _write(root / "City=A" / "Zone=1" / "b.parquet", DateTime=pa.array(times, pa.timestamp("ns")), RouteId=[7] * 3, Vehicles=[1, 2, 3])
    _write(root / "City=A" / "Zone=2" / "c.parquet", DateTime=[str(t) for t in times], RouteId=["r"] * 3, Vehicles=["1", "x", "2"])
    _write(root / "City=B" / "Zone=2" / "d.parquet", Other=[1])
    with pytest.warns(UserWarning, match="d.parquet lacks DateTime"):
        got = observations.read_observations(spark, str(root)).collect()
    assert sorted((r["City"], r["Zone"], r["RouteId"], r["Vehicles"], r["DateTime"].hour) for r in got if r["Vehicles"] is not None) == [
        ("A", "1", "7", 1.0, 0), ("A", "1", "7", 2.0, 1), ("A", "1", "7", 3.0, 2), ("A", "1", "r", 1.5, 0), ("A", "1", "r", 3.0, 2),
        ("A", "2", "r", 1.0, 0), ("A", "2", "r", 2.0, 2),
    ]
    assert len(got) == 9 and {r["DateTime"].date() for r in got} == {dt.date(2024, 1, 1)}
    kinds = {r["path"][-9:]: r["kinds"] for r in observations.describe_files(spark, str(root)).collect()}
    assert kinds["b.parquet"] == "timestamp[ns]|int64|int64" and kinds["d.parquet"] is None
    (root / "City=B" / "Zone=2" / "d.parquet").unlink()
    _write(root / "City=B" / "Zone=2" / "e.parquet", DateTime=seconds, RouteId=["e"] * 3, Vehicles=[1.0] * 3)
    with pytest.raises(ValueError, match="say time_unit"):
        observations.read_observations(spark, str(root))
    got = observations.load_slice(spark, str(root), "B", "2", start="2024-01-01T01:00:00", time_unit="s").collect()
    assert sorted(r["DateTime"] for r in got) == times[1:]


@pytest.mark.parametrize("unit, per_second", [("s", 1), ("ms", 1000), ("us", 10**6), ("ns", 10**9)])
def test_whole_number_times_have_a_unit(spark, tmp_path, unit, per_second):
    at = dt.datetime(2024, 3, 1, 5)
    count = int(at.replace(tzinfo=dt.timezone.utc).timestamp()) * per_second
    _write(tmp_path / "ds" / "A" / "f.parquet", DateTime=[count], RouteId=["r"], Vehicles=[1.0])
    got = observations.load_all(spark, str(tmp_path / "ds"), layout="plain", time_unit=unit).collect()
    assert [(r["DateTime"], r["City"], r["Zone"]) for r in got] == [(at, "A", None)]
