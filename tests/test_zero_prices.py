"""Days whose last price is zero: infinite and undefined returns go through every step as in SQL."""

import os

import duckdb
import pytest

from tidemark.plans import catalog, catalog_more

SF = "/root/testdata/sf0.001"
NAMES = [
    "a12_severity_counts", "a16_pooled_spearman", "a17_per_company_spearman", "a23_decile_bins", "c01_company_day_features", "c02_panel_forward_vol",
    "c07_panel_study", "c20_alert_feed", "c21_risk_detail", "c25_closed_extract", "f08_min_history", "f13_unexplained_alerts", "w01_log_returns",
]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Every third company has a day of zeros, every fifth two in a row."""
    at = tmp_path_factory.mktemp("zeros")
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f != "events.parquet":
            os.symlink(f"{SF}/{f}", at / f)
    zero = "(user_id % 3 = 0 AND day(ts) = 10) OR (user_id % 5 = 0 AND day(ts) BETWEEN 16 AND 17)"
    con.sql(f"COPY (SELECT * REPLACE (CASE WHEN {zero} THEN 0.0 ELSE value END AS value) FROM '{SF}/events.parquet') TO '{at}/events.parquet'")
    for f in os.listdir(at):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{at}/{f}'")
    return con, str(at)


@pytest.mark.parametrize("name", NAMES)
def test_rows_are_those_of_the_sql(spark, tables, name):
    con, at = tables
    out = (catalog.QUERIES | catalog_more.QUERIES)[name](spark, at)
    found = con.sql((catalog.ORACLE_SQL | catalog_more.ORACLE_SQL)[name])
    columns = list(found.columns)
    assert sorted(columns) == sorted(out.columns)
    assert sorted(repr([r[c] for c in columns]) for r in out.collect()) == sorted(repr(list(r)) for r in found.fetchall())


def test_there_are_infinite_and_undefined_returns(spark, tables):
    con, at = tables
    found = {repr(r["ret"]) for r in catalog.QUERIES["w01_log_returns"](spark, at).collect()}
    assert {"inf", "-inf", "nan", "None"} <= found
