"""Closed extracts, databases, JSON out of answers, and summaries of ingestion."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.functions import text as X
from tidemark.operators import closure, ingest
from tidemark.plans import catalog_more
from tidemark.sources import jdbc

REFERS = {"b": {"a_id": ("a", "id")}, "c": {"b_id": ("b", "id"), "a_id": ("a", "id")}, "d": {"d_id": ("d", "id")}}


def tables(spark):
    return {
        "c": spark.createDataFrame([(1, 1, 1), (2, 2, None), (3, 9, 1), (4, 3, 1)], "id int, b_id int, a_id int"),
        "d": spark.createDataFrame([(1, None), (2, 1), (3, 7)], "id int, d_id int"),
        "b": spark.createDataFrame([(1, 1), (2, None), (3, 8)], "id int, a_id int"),
        "a": spark.createDataFrame([(1,), (1,), (2,)], "id int"),
    }


def test_order_of_references():
    assert closure.in_order(["c", "d", "b", "a"], REFERS) == ["d", "a", "b", "c"]
    assert closure.in_order([], REFERS) == []
    with pytest.raises(ValueError):
        closure.in_order(["x", "y"], {"x": {"y": ("y", "id")}, "y": {"x": ("x", "id")}})


def test_closed_and_dangling(spark):
    hang = {(r["table"], r["reference"]): (r["rows"], r["dangling"]) for r in closure.dangling(tables(spark), REFERS).collect()}
    assert hang == {("a", ""): (3, 0), ("b", "a_id"): (3, 1), ("c", "b_id"): (4, 1), ("c", "a_id"): (4, 0), ("d", "d_id"): (3, 1)}
    kept = closure.closed(tables(spark), REFERS)
    ids = {name: sorted(r["id"] for r in rows.collect()) for name, rows in kept.items()}
    assert ids == {"a": [1, 1, 2], "b": [1, 2], "c": [1, 2], "d": [1, 2]}  # row 4 of c goes with row 3 of b
    assert all(r["dangling"] == 0 for r in closure.dangling(kept, REFERS).collect())
    fewer = closure.closed(tables(spark), REFERS, {"a": tables(spark)["a"].where("id = 2")})
    assert sorted(r["id"] for r in fewer["c"].collect()) == [2]


def test_copy_that_starts_again(spark, monkeypatch):
    """A failure between two tables, and one within a table: what is there isn't doubled."""
    url = catalog_more.database(spark)
    rows = {
        "child": spark.createDataFrame([(k, f"it's {k}" if k else None, k % 3) for k in range(60)], "id long, name string, parent long").repartition(3),
        "parent": spark.createDataFrame([(k, dt.date(2026, 1, 1 + k)) for k in range(3)], "id long, day date"),
        "empty_one": spark.createDataFrame([], "id long, x double"),
    }
    keys, refers = dict.fromkeys(rows, "id"), {"child": {"parent": ("parent", "id")}}
    failed = []

    def order(names, references):
        yield "parent"
        failed.append(1)
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(jdbc, "in_order", order)
        with pytest.raises(OSError):
            jdbc.copy(rows, keys, refers, url)
    assert jdbc.exists(spark, url, "parent") and not jdbc.exists(spark, url, "child")
    jdbc.copy({"child": rows["child"].where("id < 25")}, keys, {}, url)
    for _ in range(2):
        assert jdbc.copy(rows, keys, refers, url) == {"child": 60, "parent": 3, "empty_one": 0}
    for name, df in rows.items():
        assert sorted(map(tuple, jdbc.scan(spark, url, name, "id", 4).collect())) == sorted(map(tuple, df.collect()))


def test_scans_are_partitioned_and_pruned(spark):
    url = catalog_more.database(spark)
    jdbc.copy({"t": spark.range(100).select("id", (F.col("id") * 2).alias("v"), F.lit("x").alias("w"))}, {"t": "id"}, {}, url)
    df = jdbc.scan(spark, url, "t", "id", 5).where("v > 20").select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*GreaterThan(v,20)]" in plan.replace("IsNotNull(v), ", "").replace("*IsNotNull(v), ", "") or "GreaterThan(v,20)" in plan
    assert "w" not in plan.split("ReadSchema")[1]
    assert jdbc.scan(spark, url, "t", "id", 5).rdd.getNumPartitions() == 5
    assert sorted(r["id"] for r in df.collect()) == list(range(11, 100))


# --- JSON


def scanned(text):
    """Character by character."""
    s = text.strip()
    if s.startswith("```"):
        s = s.strip("`")
        s = (s[4:] if s[:4].lower() == "json" else s).strip()
    if "{" not in s:
        return s
    at = s.index("{")
    depth, quoted, escaped = 0, False, False
    for i in range(at, len(s)):
        c = s[i]
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return s[at : i + 1]
    return s[at:]


def test_first_json_of_random_text(spark):
    rng = random.Random(6)
    texts = ["", "  ", "{", "}", '{"a": "\\\\"} x', 'x \\{"}', '```json\n{"a": 1}\n```', "```JSON{}```", "``` {} `", '{"é": "日😀}"} 😀', '{"a": "' + "x" * 50_000 + '"} tail']
    texts += ["".join(rng.choice(['"', "\\", "{", "}", "{", "}", "a", " ", "\n", "é", "😀"]) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(expr.first_json(F.col("t"))).collect()]
    assert got == [scanned(t) for t in texts] == [X.first_json(t) for t in texts]
    assert spark.createDataFrame([(None,)], "t string").select(expr.first_json(F.col("t"))).first()[0] is None


# --- ingestion


def test_ticker_summaries(spark):
    page = "<p>Item 1A. Risk Factors " + "We may lose money. " * 300 + "Item 1B. Unresolved Staff Comments</p>"
    tickers = spark.createDataFrame([("aa",), ("AA",), ("bb",), ("cc",), ("dd",)], "ticker string")
    ciks = spark.createDataFrame([("AA", "1"), ("BB", "2"), ("DD", "4")], "ticker string, cik string")
    filings = [("1", f"n{k}", dt.date(2020 + k, 1, 1), page if k != 3 else None) for k in range(5)] + [("4", "z", dt.date(2020, 1, 1), "")]
    out = ingest.ticker_summaries(tickers, ciks, spark.createDataFrame(filings, "cik string, accession_number string, filed_date date, html string"))
    got = {r["ticker"]: r for r in out.collect()}
    assert {t: (r["status"], r["filings_stored"]) for t, r in got.items()} == {"AA": ("ok", 2), "BB": ("no_10k", 0), "CC": ("not_found", 0), "DD": ("ok", 1)}
    assert [(q["accession"], q["status"]) for q in got["AA"]["quality"]] == [("n2", "extracted"), ("n3", "fetch_failed"), ("n4", "extracted")]
