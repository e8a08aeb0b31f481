"""The ranking of many columns and groups, and as-of joins in two levels."""

import bisect
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, pit, rankings, ranks


def average_ranks(x):
    order = sorted(x)
    return [bisect.bisect_left(order, v) + (bisect.bisect_right(order, v) - bisect.bisect_left(order, v) + 1) / 2 for v in x]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    nan, out = float("nan"), []
    for g, n in (("hot", 3000), ("few", 4), (None, 40), ("flat", 20), ("none", 3)):
        for _ in range(n):
            x = 0.0 if g == "hot" and rng.random() < 0.5 else rng.choice([None, nan, -0.0, rng.randint(-5, 5) * 1.0, rng.gauss(0, 1)])
            y = 1.0 if g == "flat" else rng.choice([None, rng.randint(0, 9) * 1.0, rng.gauss(0, 1) + (x or 0)])
            out.append((g, None if g == "none" else x, y, rng.choice([None, "a", "b", "c"])))
    return out


def usable(v):
    return v is not None and v == v


@pytest.mark.parametrize("hot", [1000, 10, 1])
def test_study(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(rankings, "HOT", hot)
    df = spark.createDataFrame(rows, "g string, x double, y double, label string").repartition(6)
    rho, sums = rankings.study(["g"], df.select("g", "x", "y"), df.select("g", "x", "label"))
    got = {r["g"]: (r["rho"], r["n"]) for r in rho.collect()}
    h = {r["g"]: r for r in rankings.kruskal_of(sums, ["g"]).collect()}
    u = {r["g"]: r for r in rankings.mann_whitney_of(sums, ["g"], "a").collect()}
    assert set(got) == {"hot", "few", None, "flat"} - ({"few"} if "few" not in got else set())
    for g in got:
        pairs = [(x, y) for k, x, y, _ in rows if k == g and usable(x) and usable(y)]
        rx, ry = average_ranks([p[0] for p in pairs]), average_ranks([p[1] for p in pairs])
        want = None if len(pairs) < 5 or len(set(rx)) < 2 or len(set(ry)) < 2 else np.corrcoef(rx, ry)[0, 1]
        assert got[g] == ((None if want is None else pytest.approx(want)), len(pairs))
    for g in h:
        one = [(x, label) for k, x, _, label in rows if k == g and usable(x) and label]
        r, n = average_ranks([p[0] for p in one]), len(one)
        assert h[g]["n"] == n
        a = [v for v, (_, label) in zip(r, one) if label == "a"]
        assert u[g]["n1"] == len(a) and u[g]["n2"] == n - len(a)
        if len(a) >= 5 and n - len(a) >= 5:
            assert u[g]["u"] == sum(a) - len(a) * (len(a) + 1) / 2
    hot_rows = spark.createDataFrame([(x, label) for k, x, _, label in rows if k == "hot"], "x double, g string").where("not isnan(x)")
    assert h["hot"]["h"] == pytest.approx(ranks.kruskal(hot_rows, "x", "g").first()["h"])


def test_study_of_nothing(spark):
    none = spark.createDataFrame([], "g string, x double, y double")
    rho, sums = rankings.study(["g"], none, none.select("g", "x", F.col("g").alias("label")))
    assert rho.collect() == [] and sums.collect() == []


def test_quantiles_by_group(spark, rows):
    df = spark.createDataFrame(rows, "g string, value double, y double, label string").repartition(5)
    shares = [0.0, 0.1, 1 / 3, 0.5, 2 / 3, 1.0]
    got = {(r["g"], r["label"]): (r["n"], r["q"]) for r in rankings.quantiles_by(df, ["g", "label"], shares).collect()}
    want = {}
    for g, x, _, label in rows:
        if usable(x):
            want.setdefault((g, label), []).append(x)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == (len(v), pytest.approx(np.quantile(v, shares).tolist()))


def test_ranges_split_a_large_group(spark):
    """A group with most values is dealt over many tasks."""
    df = spark.range(40_000).select(F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(-1).alias("g"), F.rand(5).alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = df.repartitionByRange("g", "value").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = sorted(r["count"] for r in parts)
    assert len(sizes) >= 4 and sizes[-1] < 2 * sizes[len(sizes) // 2]


# --- as-of


def brute_asof(left, right, forward):
    out = []
    for i, k, t in left:
        fit = [(u, v) for q, u, v in right if k is not None and t is not None and q == k and u is not None and (u >= t if forward else u <= t)]
        out.append((i, None if not fit else (min if forward else max)(fit, key=lambda r: (r[0], r[1] if forward else -r[1]))[1]))
    return sorted(out)


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("days,parts", [(1, 1), (7, 3), (400, 1)])
def test_asof(spark, forward, days, parts):
    rng = random.Random(days)
    for kind, one in (("date", lambda: dt.date(1969, 11, 1) + dt.timedelta(days=rng.randint(0, 200))), ("timestamp", lambda: dt.datetime(1969, 12, 1) + dt.timedelta(seconds=rng.randint(0, 90 * 86400)))):
        left = [(i, rng.choice(["a", "a", "a", "b", "gone", None]), rng.choice([None] + [one()] * 20)) for i in range(200)]
        right = [(rng.choice(["a", "b", "other", None]), rng.choice([None] + [one()] * 20), v) for v in range(60)]
        right += [("a", right[0][1], 1000), ("a", right[0][1], 900)]
        x = spark.createDataFrame(left, f"id int, k string, at {kind}").repartition(3)
        y = spark.createDataFrame(right, f"k string, day {kind}, v int")
        got = asof.asof(x, y, "k", "at", "day", ["v"], forward, "left", days, parts)
        assert sorted(map(tuple, got.select("id", "v").collect())) == brute_asof(left, right, forward)
        inner = asof.asof(x, y, "k", "at", "day", ["v", "k"], forward, "inner", days, parts).collect()
        assert sorted((r["id"], r["v"]) for r in inner) == [r for r in brute_asof(left, right, forward) if r[1] is not None]
        assert all(r["right_k"] == r["k"] for r in inner)


def test_asof_of_nothing(spark):
    x, y = spark.createDataFrame([], "k string, at date"), spark.createDataFrame([], "k string, day date, v int")
    assert asof.asof(x, y, "k", "at", "day", ["v"]).collect() == []
    with pytest.raises(ValueError):
        asof.asof(x, y.withColumn("day", F.current_timestamp()), "k", "at", "day", ["v"])


def test_nothing_after_the_cutoff_is_seen(spark):
    bars = spark.createDataFrame([("A", dt.date(2026, 1, d), float(d)) for d in (1, 5, 9)], "ticker string, date date, close double")
    cutoffs = spark.createDataFrame([("A", dt.date(2026, 1, d)) for d in (1, 4, 5, 8, 31)] + [("A", dt.date(2025, 1, 1)), ("B", dt.date(2026, 1, 5))], "ticker string, at date")
    got = {(r["ticker"], r["at"]): r["close"] for r in pit.PointInTime(bars).last_before(cutoffs, "at", ["close"], days=3).collect()}
    assert list(got.values()).count(None) == 2
    assert [got["A", dt.date(2026, 1, d)] for d in (1, 4, 5, 8, 31)] == [1.0, 1.0, 5.0, 5.0, 9.0]


def test_a_key_with_most_rows_is_many_tasks(spark):
    """Of 20,000 rows of one key, no part of the merge has over twice the median."""
    rows = spark.range(20_000).select(F.lit("A").alias("k"), F.expr("date '2020-01-01' + cast(id % 2000 as int)").alias("at"), "id")
    days = spark.range(2000).select(F.lit("A").alias("k"), F.expr("date '2020-01-01' + cast(id as int)").alias("day"))
    sizes = [r["count"] for r in rows.groupBy("k", F.floor(F.datediff("at", F.lit("1970-01-01")) / asof.WIDTH).alias("b")).count().collect()]
    assert len(sizes) > 50 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    assert asof.asof(rows, days, "k", "at", "day", ["day"]).where("day <> at").count() == 0
