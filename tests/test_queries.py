import glob
import os

import duckdb
import pytest

from weftline.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        made.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return made


def plain(row):
    return repr(tuple(round(v, 6) if isinstance(v, float) else v for v in row))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equal_to_sql(spark, con, name):
    frame = catalogue.QUERIES[name](spark, DATA)
    found = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(plain(r) for r in frame.select(*(f"`{n}`" for n in names)).collect()) == sorted(map(plain, found.fetchall()))


def test_filters_and_columns_reach_the_scan(spark, capsys):
    catalogue.QUERIES["where_cmp"](spark, DATA).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan or "LessThanOrEqual(l_quantity" in plan
    assert "ReadSchema: struct<l_orderkey" in plan and "l_comment" not in plan.split("ReadSchema:")[1].split("\n")[0]
