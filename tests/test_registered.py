"""Registered queries against their oracle SQL on the smallest test data.

One query of each family by default; all of them with REGISTERED=all, or through
`python -m checks.compare`.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
FAMILIES = (
    "row01_07_inventory_row_metrics",
    "win08_12_campaign_window_metrics",
    "agg01_per01_08_wix02_inventory_period_summary",
    "agg02_08_ent32_55_campaign_entity_summary",
    "agg09_joi06_dim01_06_inventory_dimension_summary",
    "rsk01_10_inventory_risks",
    "top03_campaign_movers",
    "joi02_period_deltas",
    "ded02_ded03_last_record",
    "im01_03_imx01_imx03_inventory_imputation",
    "qua03_04_inventory_violation_counts",
    "qua06_qry05_csv_quality_issues",
    "grd03_04_verified_claims",
    "src10_src13_ledger_after_delete",
    "agg14_call_log_rollup",
)
NAMES = sorted(entry.queries()) if os.environ.get("REGISTERED") == "all" else FAMILIES
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    frame = entry.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in frame.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert canonical(frame.columns, rows) == canonical(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
