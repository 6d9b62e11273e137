"""Each catalogue query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tallyloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(rows, columns, names):
    at = [columns.index(c) for c in sorted(names)]
    cell = lambda v: "-" if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(repr([cell(r[i]) for i in at]) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, name):
    df = catalogue.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(rows, df.columns, columns) == plain([tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in got.fetchall()], columns, columns)
