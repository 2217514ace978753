"""Source queries take every zone and every event type that their table contains."""

import datetime as dt

from lanewise.catalog import source_queries
from lanewise.catalog import tables as t


def test_plain_folders_hold_every_zone(spark, monkeypatch):
    at = dt.datetime(2024, 1, 5, 6)
    rows = [(at, "Metro", zone, "click", float(k)) for k, zone in enumerate(["Z1", "Z4", "Z5", None])]
    table = spark.createDataFrame(rows, "DateTime timestamp_ntz, City string, Zone string, RouteId string, Vehicles double")
    monkeypatch.setattr(t, "obs", lambda spark, sf: table)
    got = source_queries.src_01_plain(spark, "").collect()
    assert sorted((r["Vehicles"], r["Zone"]) for r in got) == [(0.0, "Z1"), (1.0, "Z4"), (2.0, "Z5"), (3.0, None)]


def test_interstate_averages_every_event_type(spark, monkeypatch):
    hour = dt.datetime(2024, 1, 5, 6)
    rows = [(1, hour, "click", 2.0), (2, hour, "error", 4.0), (3, hour, "view", 9.0), (4, hour + dt.timedelta(hours=2), "click", 7.0)]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double")
    monkeypatch.setattr(t, "load", lambda spark, sf, name: table)
    got = sorted((r["DateTime"].hour, r["Vehicles"]) for r in source_queries.src_04(spark, "").collect())
    assert got == [(6, 5.0), (7, 6.0), (8, 7.0)]
