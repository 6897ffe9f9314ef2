"""Deliveries of more customers than there are numbers, against the SQL."""

import os
from collections import Counter

import duckdb
import pytest

from quarry.plans.catalogue import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
NAMES = ["delivery_search", "delivery_search_range", "download_json", "download_plan", "select_all_mapped", "select_priority", "status_transition"]


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Customers, and as many more of the same numbers; half of these have a status where the first has none, and none where it has one."""
    out = str(tmp_path_factory.mktemp("deliveries"))
    shift = {"customer": ("c_custkey", 89999), "orders": ("o_custkey", 89999), "lineitem": ("l_orderkey", 10**6)}
    for t, (key, by) in shift.items():
        at = f"{DIR}/{t}.parquet"
        more = f"{key} + {by} AS {key}" + (f", o_orderkey + {10**6} AS o_orderkey" if t == "orders" else ", CASE WHEN c_custkey % 2 = 0 THEN -c_acctbal ELSE c_acctbal END AS c_acctbal" if t == "customer" else "")
        duckdb.sql(f"COPY (SELECT * FROM '{at}' UNION ALL SELECT * REPLACE ({more}) FROM '{at}') TO '{out}/{t}.parquet' (FORMAT parquet)")
    os.symlink(f"{DIR}/documents.parquet", f"{out}/documents.parquet")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_customers_of_one_number(spark, repeated, name):
    db = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "documents"):
        db.execute(f"create view {t} as select * from read_parquet('{repeated}/{t}.parquet')")
    got = QUERIES[name](spark, repeated)
    want = db.execute(f"select {', '.join(got.columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want) and want


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Customers, some of them twice, and as many whose numbers have seven and eight digits."""
    out = str(tmp_path_factory.mktemp("odd"))
    at = f"{DIR}/customer.parquet"
    duckdb.sql(f"COPY (SELECT * FROM '{at}' UNION ALL SELECT * FROM '{at}' WHERE c_custkey % 3 = 0 UNION ALL SELECT * REPLACE (c_custkey + 100000000 AS c_custkey) FROM '{at}' UNION ALL SELECT * REPLACE (c_custkey + 1000000000 AS c_custkey) FROM '{at}') TO '{out}/customer.parquet' (FORMAT parquet)")
    for t in ("orders", "lineitem", "documents"):
        os.symlink(f"{DIR}/{t}.parquet", f"{out}/{t}.parquet")
    return out


@pytest.mark.parametrize("name", ["download_json", "download_plan", "select_all_mapped", "select_priority"])
def test_repeated_rows_and_long_numbers(spark, odd, name):
    test_customers_of_one_number(spark, odd, name)


@pytest.mark.parametrize("name", ["download_json", "download_plan", "select_all_mapped", "select_priority"])
def test_negative_keys_and_keys_beyond_doubles(spark, tmp_path, name):
    at = f"{DIR}/customer.parquet"
    duckdb.sql(f"COPY (SELECT * FROM '{at}' UNION ALL SELECT * REPLACE (-c_custkey AS c_custkey) FROM '{at}' UNION ALL SELECT * REPLACE (c_custkey + 30000000000000017 AS c_custkey) FROM '{at}') TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    o = f"{DIR}/orders.parquet"
    duckdb.sql(f"COPY (SELECT * FROM '{o}' UNION ALL SELECT * REPLACE (-o_custkey AS o_custkey, o_orderkey + 1000000 AS o_orderkey) FROM '{o}' UNION ALL SELECT * REPLACE (o_custkey + 30000000000000017 AS o_custkey, o_orderkey + 2000000 AS o_orderkey) FROM '{o}') TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    for t in ("lineitem", "documents"):
        os.symlink(f"{DIR}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    test_customers_of_one_number(spark, str(tmp_path), name)


@pytest.mark.parametrize("name", ["download_json", "download_plan"])
def test_negative_and_null_order_keys(spark, tmp_path, name):
    """Versions of negative order keys, beside others, alone, and beside null keys."""
    shift = {"orders": "-o_orderkey AS o_orderkey", "lineitem": "-l_orderkey AS l_orderkey"}
    for t, more in shift.items():
        at = f"{DIR}/{t}.parquet"
        nulls = f" UNION ALL SELECT * REPLACE (CAST(NULL AS BIGINT) AS {more.split()[-1]}) FROM '{at}' WHERE {more.split()[-1]} % 11 = 0"
        duckdb.sql(f"COPY (SELECT * FROM '{at}' WHERE {more.split()[-1]} % 3 = 0 UNION ALL SELECT * REPLACE ({more}) FROM '{at}'{nulls}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    for t in ("customer", "documents"):
        os.symlink(f"{DIR}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    test_customers_of_one_number(spark, str(tmp_path), name)
