"""Every query gives the rows of its SQL."""

import pytest

from tallyscript.plans import files, more  # noqa: F401  add their queries
from tallyscript.plans.queries import QUERIES, SQL
from tests.oracle import connect, rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, con, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(con.sql(SQL[name]).df())


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(SQL)


def test_clock_roundtrip_of_all_events(spark, tmp_path):
    spark.createDataFrame([(7,), (359_939,), (359_940,), (6_000_001,)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: (r.clock, r.seconds) for r in QUERIES["clock_roundtrip"](spark, str(tmp_path)).collect()}
    assert got == {7: ("00:07", 7.0), 359_939: ("5998:59", 359_939.0), 359_940: ("5999:00", 359_940.0), 6_000_001: ("100000:01", 6_000_001.0)}


def test_no_cartesian_product(spark, sf_dir):
    for name in ("nearest_match", "consensus_v04_flagged", "consensus_v03_flagged", "chunk_vad_info", "speech_segments"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
