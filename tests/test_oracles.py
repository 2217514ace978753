"""Every registered query against its SQL in DuckDB."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry
from lanewise.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    count, note = differences(
        spark, con, name, QUERIES[name], ORACLES.get(name), SF
    )
    assert note == ""
    assert count > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_inventory_row_is_registered():
    ids = {n.rsplit("_")[0] + "_" + n.split("_")[1] for n in QUERIES}
    expected = {
        f"{prefix}_{i:02d}"
        for prefix, last in (
            ("src", 10), ("snk", 8), ("flt", 14), ("joi", 7), ("agg", 22), ("met", 11),
            ("win", 11), ("ord", 3), ("set", 4), ("scl", 17), ("fc", 18),
        )
        for i in range(1, last + 1)
    }
    assert expected <= ids
