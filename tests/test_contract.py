import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check_oracles import compare

SF = "/root/testdata/sf0.001"
QUICK = ("rule_score", "timeline_buckets", "parse_hdfs", "cidr_range_join", "response_plan", "ledger_verify", "line_confusion")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and all(r.anomaly_score >= 0.45 for r in rows)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.queries()) if os.environ.get("ALL_QUERIES") else QUICK)
def test_query_matches_oracle(spark, duck, name):
    line = compare(spark, duck, SF, name, contract.queries()[name], contract.oracle_sql().get(name))
    assert not line.startswith("FAIL"), line
