"""Every query of the second catalogue against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tidemark.plans import catalog_files

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog_files.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    out = catalog_files.QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    found = con.sql(catalog_files.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    got = sorted(repr([r[c] for c in columns]) for r in out.collect())
    assert got == sorted(repr([r[i] for i in at]) for r in found.fetchall())
