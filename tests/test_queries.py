"""Every registered query against DuckDB on the smallest tables, and checks of the physical plans."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from gustline.operators.ordered import ROWS_PER_SLICE_SETTING
from gustline.plans import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
KINDS = {
    "int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    sql = contract.oracle_sql()[name]
    columns = sorted(df.columns)
    kinds = {r[0]: str(r[1]) for r in duck.execute(f"DESCRIBE {sql}").fetchall()}
    assert {c: KINDS[t] for c, t in df.dtypes} == kinds
    want = duck.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({sql})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


ORDERED = (
    "gap_rows", "backwards_rows", "highwater_accept", "change_only", "consecutive_dup", "dup_summary", "plateau_flag",
    "rollover_segments", "retime_repair", "audit_repair", "publish_minute", "section_lines", "section_files", "gap_rows_offset",
)


@pytest.mark.parametrize("name", ORDERED)
def test_ordered_query_equals_sql_when_keys_are_sliced(spark, duck, name):
    spark.conf.set(ROWS_PER_SLICE_SETTING, "3" if name.startswith("section") else "40")
    try:
        test_query_equals_sql(spark, duck, name)
    finally:
        spark.conf.unset(ROWS_PER_SLICE_SETTING)


def test_entry(spark):
    assert contract.entry(spark).columns == ["station", "obs_date", "max_value", "min_value", "n_obs", "slope"]


def plan_of(spark, name):
    return contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))


@pytest.mark.parametrize("name", BATCH)
def test_plan_has_no_cross_join_python_or_single_partition_window(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "MapInPandas" not in plan
    for line in plan.splitlines():
        if " Window [" in line or "+- Window [" in line:
            assert "], [" in line, line


def test_predicates_reach_the_scan(spark):
    assert "GreaterThanOrEqual(l_shipdate" in plan_of(spark, "combine_range")
    assert "GreaterThanOrEqual(ts" in plan_of(spark, "date_slice")
    assert "EqualTo(event_type,click)" in plan_of(spark, "station_filter")


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(spark, "daily_summary")
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_daily_summary_shuffles_once(spark):
    assert plan_of(spark, "daily_summary").count("Exchange hashpartitioning") == 1
    assert plan_of(spark, "rollover_segments").count("Exchange hashpartitioning") == 1


def test_scans_and_shuffles_of_the_cheaper_plans(spark):
    scans = {"gap_fill": 1, "retime_repair": 1, "source_fallback": 1}
    for name, n in scans.items():
        assert plan_of(spark, name).count("FileScan") == n, name
    assert plan_of(spark, "source_fallback").count("Exchange hashpartitioning") == 1
    # contents are hashed before they travel
    before, _, _ = plan_of(spark, "new_content_anti").partition("FileScan")
    assert "max_by(props" not in before
