"""Registered queries against their SQL on tables that the test folders don't have."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pactum import queries


@pytest.mark.parametrize("keys", [[18] * 100, [19] * 1200, [3, 24]])
def test_fold_product_equals_its_sql(spark, tmp_path, keys):
    pq.write_table(pa.table({"s_suppkey": pa.array(range(len(keys)), pa.int64()), "s_nationkey": pa.array(keys, pa.int32())}), tmp_path / "supplier.parquet")
    db = duckdb.connect()
    db.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet'")
    want = db.execute(queries.oracle_sql()["fold_product"]).fetchall()
    assert [tuple(r) for r in queries.queries()["fold_product"](spark, str(tmp_path)).collect()] == want
