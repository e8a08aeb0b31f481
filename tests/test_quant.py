"""Point in time, returns, statistics, regimes, backtests and the limiter."""

import datetime as dt
import math
import random
from collections import deque
from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import backtest, labels, limits, panel, pit, quantiles, ranks, regime
from tidemark.sources import readers

D = dt.date


def day(k, start=D(2026, 1, 1)):
    return start + dt.timedelta(days=k)


@pytest.fixture(scope="module")
def bars(spark):
    rows = [("AAA", day(2), 10.5), ("AAA", day(0), 10.0), ("AAA", day(4), 11.0), ("AAA", day(1), 10.2), ("AAA", day(3), 10.8), ("BBB", day(2), 5.0)]
    return spark.createDataFrame(rows, "ticker string, date date, close double")


def test_point_in_time(bars):
    view = pit.PointInTime(bars)
    assert [r["close"] for r in view.bars("AAA", "2026-01-03").collect()] == [10.0, 10.2, 10.5]
    assert view.bars("AAA", "2025-12-31").count() == 0
    assert view.bars("AAA", "2099-01-01").count() == 5
    assert view.bars("ZZZ", "2099-01-01").count() == 0
    days = lambda n, d: sorted(r["date"].day for r in view.lookback(n, d).where("ticker = 'AAA'").collect())
    assert days(2, "2026-01-03") == [2, 3] and days(10, "2026-01-02") == [1, 2] and days(0, "2026-01-05") == []
    assert view.bars("BBB", "2026-01-02").count() == 0 and view.bars("BBB", "2026-01-03").count() == 1


def test_returns_skip_pairs_with_bad_closes(spark):
    df = spark.createDataFrame([("A", day(0), 100.0), ("A", day(1), 0.0), ("A", day(2), 105.0), ("A", day(3), 110.25)], "ticker string, date date, close double")
    assert [r["ret"] for r in pit.log_returns(df).collect()] == [pytest.approx(math.log(1.05))]


def test_moments_match_python_and_constants_have_values(spark):
    x = [0.01, -0.02, 0.015, -0.005, 0.02, -0.01, 0.008]
    df = spark.createDataFrame([("a", v) for v in x] + [("c", 0.01)] * 4, "k string, ret double")
    got = {r["k"]: r for r in pit.moments(df, "k").collect()}
    for name, f in (("mean", stats.mean), ("sd", stats.stddev), ("sharpe", stats.sharpe_ratio), ("skewness", stats.skewness), ("kurtosis", stats.kurtosis)):
        assert got["a"][name] == pytest.approx(f(x))
    assert (got["c"]["sharpe"], got["c"]["skewness"], got["c"]["kurtosis"]) == (0, 0, 3)
    assert stats.stddev([1, 2, 3, 4, 5]) == pytest.approx(math.sqrt(2)) and stats.skewness([-2, -1, 0, 1, 2]) == pytest.approx(0)


def test_sharpe_probabilities():
    for p, z in ((0.5, 0), (0.975, 1.959964), (0.995, 2.575829), (0.9, 1.281552), (0.025, -1.959964)):
        assert stats.inverse_normal_cdf(p) == pytest.approx(z, abs=1e-6)
        assert stats.normal_cdf(z) == pytest.approx(p, abs=1e-6)
    for p in (0, 1, -1, 2):
        with pytest.raises(ValueError):
            stats.inverse_normal_cdf(p)
    x = [0.01, -0.02, 0.015, -0.005, 0.02, -0.01, 0.008]
    assert stats.probabilistic_sharpe_ratio(x, stats.sharpe_ratio(x)) == pytest.approx(0.5)
    assert stats.deflated_sharpe_ratio(x, 1, 0.3) == pytest.approx(stats.probabilistic_sharpe_ratio(x))
    y = [*x, 0.012]
    assert stats.deflated_sharpe_ratio(y, 200, 0.3) < stats.probabilistic_sharpe_ratio(y)
    trials = [0.1, 0.3, -0.2, 0.15, 0.05, 0.25, -0.1, 0.2]
    assert stats.deflated_sharpe_ratio(y, trials) == pytest.approx(stats.deflated_sharpe_ratio(y, 8, stats.stddev(trials) ** 2))
    assert stats.expected_max_sharpe(1, 0.3) == stats.expected_max_sharpe(9, 0) == 0
    assert stats.expected_max_sharpe(10, 0.4) == pytest.approx(2 * stats.expected_max_sharpe(10, 0.1))
    with pytest.raises(ValueError):
        stats.expected_max_sharpe(5, -1)
    with pytest.raises(ValueError):
        stats.probabilistic_sharpe_ratio([0.1])


def test_p_values_of_published_tables():
    assert stats.student_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert stats.student_two_sided(1.0, 1) == pytest.approx(0.5)
    assert stats.chi2_tail(5.991, 2) == pytest.approx(0.05, abs=1e-4)
    assert stats.chi2_tail(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert stats.chi2_tail(7.815, 3) == pytest.approx(0.05, abs=1e-4)
    assert stats.mann_whitney_p(0, 5, 5) == pytest.approx(2 / 252)
    assert stats.mann_whitney_p(12.5, 5, 5) == 1
    assert sum(stats._u_counts(4, 6)) == math.comb(10, 4)
    assert stats.spearman_p(1.0, 10) == 0 and stats.spearman_p(None, 10) is None


def rank(x):
    order = sorted(x)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in x]


def test_global_ranks_and_tests_against_python(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 30) * 1.0, rng.random(), rng.choice("abc")) for _ in range(300)]
    df = spark.createDataFrame(rows, "x double, y double, g string").repartition(5)
    got = {(r["x"], r["y"]): (r["r"], r["r_ties"]) for r in ranks.global_rank(df, "x", "r", ranges=7).collect()}
    want = rank([r[0] for r in rows])
    assert all(got[r[0], r[1]][0] == w for r, w in zip(rows, want))
    rx, ry = np.array(want), np.array(rank([r[1] for r in rows]))
    assert ranks.spearman(df, "x", "y").first()["rho"] == pytest.approx(np.corrcoef(rx, ry)[0, 1])
    n, ties = len(rows), sum(c**3 - c for c in pd.Series([r[0] for r in rows]).value_counts())
    h = 12 / (n * (n + 1)) * sum(rx[[r[2] == g for r in rows]].sum() ** 2 / sum(r[2] == g for r in rows) for g in "abc") - 3 * (n + 1)
    assert ranks.kruskal(df, "x", "g").first()["h"] == pytest.approx(h / (1 - ties / (n**3 - n)))
    u = ranks.mann_whitney(df, "x", F.col("g") == "a").first()
    first = [r[0] for r in rows if r[2] == "a"]
    rest = [r[0] for r in rows if r[2] != "a"]
    assert u["u"] == sum((a > b) + 0.5 * (a == b) for a in first for b in rest) and u["ties"] == ties


def test_spearman_guards_and_summary(spark):
    up = [("u", float(i), float(i)) for i in range(10)]
    down = [("d", float(i), float(-i)) for i in range(10)]
    few = [("f", float(i), float(i)) for i in range(5)]
    make = lambda rows: spark.createDataFrame(rows, "ticker string, x double, y double")
    assert ranks.spearman(make(up), "x", "y").first()["rho"] == pytest.approx(1)
    assert ranks.spearman(make(down), "x", "y").first()["rho"] == pytest.approx(-1)
    assert ranks.spearman(make(up[:4]), "x", "y").first()["rho"] is None
    assert ranks.spearman(make([("a", 1.0, float(i)) for i in range(9)]), "x", "y").first()["rho"] is None
    assert tuple(ranks.spearman_summary(make(few), "ticker", "x", "y").first()) == (None, None, 0)
    both = ranks.spearman_summary(make(up + down), "ticker", "x", "y").first()
    assert (both["median_rho"], both["share_positive"], both["companies"]) == (pytest.approx(0, abs=1e-12), 0.5, 2)


FILED = D(2026, 1, 15)


@pytest.mark.parametrize(
    "closes,vol,n",
    [
        ([(k + 1, 100.0) for k in range(12)], 0.0, 11),
        ([(1, 100.0), (2, 101.0), (3, 102.0)], None, 2),
        ([(0, 999.0)] + [(k + 1, 100.0) for k in range(12)], 0.0, 11),
        ([(k + 1, 100.0) for k in range(12)] + [(60, 500.0)], 0.0, 11),
        ([(k + 1, 100.0) for k in range(12)] + [(14, -1.0), (15, None)], 0.0, 11),
        ([], None, 0),
    ],
)
def test_realized_volatility(spark, closes, vol, n):
    filings = spark.createDataFrame([(1, "A", FILED)], "filing_id int, ticker string, filed_date date")
    prices = spark.createDataFrame([("A", FILED + dt.timedelta(days=k), c) for k, c in closes], "ticker string, day date, close double")
    got = labels.realized_vol(filings, prices).first()
    assert (got["realized_vol"], got["n_returns"]) == (vol, n)
    assert got["window_end"] == FILED + dt.timedelta(days=30)
    assert (got["window_start"] is None) == (vol is None)


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_quantiles_against_numpy(spark, monkeypatch, ranges):
    monkeypatch.setattr(quantiles, "cumulated", partial(quantiles.cumulated, ranges=ranges))
    rng = np.random.default_rng(ranges)
    shares = [0.0, 0.03, 1 / 3, 0.5, 2 / 3, 1.0]
    for values in ([], [None], [2.5], [1.0, 1.0, 1.0, 9.0], rng.integers(0, 20, 301).tolist(), rng.standard_normal(500).tolist()):
        df = spark.createDataFrame([(None if v is None else float(v),) for v in [*values, None]], "x double")
        real = [v for v in values if v is not None]
        got = quantiles.quantiles(df, "x", shares).first()["q"]
        assert got == ([None] * len(shares) if not real else pytest.approx(np.quantile(real, shares).tolist()))


def test_known_deviation_and_terciles(spark):
    r = [0.02 * (-1) ** k for k in range(13)]
    closes = np.exp(np.cumsum([0, *r])) * 100
    filings = spark.createDataFrame([(1, "A", FILED)], "filing_id int, ticker string, filed_date date")
    prices = spark.createDataFrame([("A", FILED + dt.timedelta(days=k + 1), float(c)) for k, c in enumerate(closes)], "ticker string, day date, close double")
    assert labels.realized_vol(filings, prices).first()["realized_vol"] == pytest.approx(np.std(r, ddof=1) * math.sqrt(252), abs=1e-9)
    vols = spark.createDataFrame([(float(v),) for v in range(1, 10)], "realized_vol double")
    low, high = labels.terciles(vols).first()
    assert [sum(v <= low for v in range(1, 10)), sum(low < v <= high for v in range(1, 10))] == [3, 3]


CLOSES = [100.0, 110.0, 121.0, 100.0, 90.0]


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame([("AAA", day(k), c) for k, c in enumerate(CLOSES)], "ticker string, date date, close double")


def run(df, position, bps=0.0, start="2026-01-01"):
    return backtest.backtest(df, position, start, "2099-01-01", bps).orderBy("date").collect()


def test_backtest(five):
    flat = run(five, F.lit(0.0))
    assert len(flat) == 4 and all(r["net_return"] == 0 and r["cost"] == 0 for r in flat)
    long = run(five, F.lit(1.0))
    assert [r["net_return"] for r in long] == [pytest.approx(math.log(b / a)) for a, b in zip(CLOSES, CLOSES[1:])]
    assert [r["date"] for r in long] == [day(k) for k in range(1, 5)]
    short = run(five, F.lit(-1.0))
    assert [r["net_return"] for r in short] == [pytest.approx(-r["net_return"]) for r in long]
    once = run(five, F.when(F.col("date") == day(1), 1.0).otherwise(0.0), 10)
    assert sum(r["changed"] for r in once) == 2 and sum(r["cost"] for r in once) == pytest.approx(0.002)
    assert run(five, F.lit(1.0), start="2099-01-01") == []


def test_rules_see_the_past_alone(five):
    decided = backtest.prefix_rule(lambda rows: float(rows["date"].max().toordinal()))(five).collect()
    seen = {r["date"]: r["position"] for r in decided}
    assert all(p == d.toordinal() for d, p in seen.items())


def test_truncating_the_future_changes_nothing_before(spark):
    rng = np.random.default_rng(3)
    closes = np.exp(np.cumsum(rng.normal(0, 0.02, 120))) * 50
    df = spark.createDataFrame([("A", day(k), float(c)) for k, c in enumerate(closes)], "ticker string, date date, close double")
    cut = df.where(F.col("date") <= F.lit(day(80)))
    params = spark.createDataFrame([("A", '{"omega": [1e-5, 2e-4], "alpha": [0.05, 0.08], "beta": [0.85, 0.8], "stay": [0.9, 0.85]}')], "ticker string, params string")
    for plan in (
        lambda x: pit.log_returns(x),
        lambda x: pit.PointInTime(x).expanding("close"),
        lambda x: regime.filter_all(x, params),
        lambda x: backtest.backtest(x, backtest.momentum(5), "2026-01-10", "2099-01-01"),
    ):
        whole = sorted(map(str, plan(df).where(F.col("date") <= F.lit(day(80))).collect()))
        assert whole == sorted(map(str, plan(cut).collect()))


PARAMS = regime.Params((1e-5, 3e-5), (0.05, 0.08), (0.85, 0.80), (0.9, 0.85))
SERIES = [0.01, -0.02, 0.015, -0.005, 0.02, -0.01, 0.03, -0.04]


def test_filter_gives_distributions():
    steps, total = regime.filtered(SERIES, PARAMS)
    assert all(sum(s) == pytest.approx(1) and min(s) >= 0 for s in steps) and math.isfinite(total)
    assert regime.filtered(SERIES[:5], PARAMS)[0] == steps[:5]
    assert regime.log_likelihood([], PARAMS) == 0


def test_parameters_survive_packing():
    back = regime.unpack(regime.pack(PARAMS, 1e-6), 1e-6)
    for a, b in zip((PARAMS.omega, PARAMS.alpha, PARAMS.beta, PARAMS.stay), (back.omega, back.alpha, back.beta, back.stay)):
        assert a == pytest.approx(b)


def test_optimizer():
    place, value, _, done = regime.nelder_mead(lambda x: (x[0] - 3) ** 2 + (x[1] + 2) ** 2, [0.0, 0.0])
    assert done and place == pytest.approx([3, -2], abs=1e-3) and value < 1e-6
    place, _, _, _ = regime.nelder_mead(lambda x: (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2, [-1.2, 1.0])
    assert place == pytest.approx([1, 1], abs=1e-2)


def test_fit_finds_two_variances_and_trials_run(spark):
    rng = np.random.default_rng(7)
    r = np.concatenate([rng.normal(0, 0.006, 180), rng.normal(0, 0.035, 60), rng.normal(0, 0.006, 60)])
    closes = 100 * np.exp(np.cumsum(r))
    df = spark.createDataFrame([("A", day(k), float(c)) for k, c in enumerate(closes)] + [("B", day(0), 1.0)], "ticker string, date date, close double")
    params = regime.calibrate(df, str(day(260)), most=120)
    found = params.collect()
    assert [x["ticker"] for x in found] == ["A"] and math.isfinite(found[0]["log_likelihood"])
    p = regime.params_of(found[0]["params"])
    assert p.unconditional(p.turbulent) >= p.unconditional(1 - p.turbulent)
    views = regime.filter_all(df, params).collect()
    assert all(v["p_turbulent"] is None or 0 <= v["p_turbulent"] <= 1 for v in views)
    best = regime.run_trials(df, params, str(day(260)), str(day(299))).collect()
    assert len(best) == 1 and best[0]["n_trials"] == 5
    with pytest.raises(ValueError):
        regime.fit([0.01] * 5)
    with pytest.raises(ValueError):
        regime.fit(SERIES * 10, regimes=3)


def test_limiter(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), dt.datetime(2026, 1, 1) + dt.timedelta(seconds=rng.randint(0, 4000)), k) for k in range(300)]
    rows += [("edge", dt.datetime(2026, 1, 1), 900), ("edge", dt.datetime(2026, 1, 1, 0, 0, 30), 901), ("edge", dt.datetime(2026, 1, 1, 0, 1), 902)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id int").repartition(4)
    got = {r["id"]: (r["allowed"], r["retry_after"]) for r in limits.admit(df, 2, 60.0).collect()}
    want, hits = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        q = hits.setdefault(k, [])
        q[:] = [x for x in q if x > t - dt.timedelta(seconds=60)]
        if len(q) >= 2:
            want[i] = (False, max(1, math.ceil((q[0] + dt.timedelta(seconds=60) - t).total_seconds())))
        else:
            q.append(t)
            want[i] = (True, None)
    assert got == want
    assert all(r["allowed"] for r in limits.admit(df, None).collect()) and all(r["allowed"] for r in limits.admit(df, 0).collect())
    assert limits.check(deque([0.0]), 1, 60.0, 59.5) == (False, 1) and limits.check(deque([0.0]), 1, 60.0, 60.0) == (True, None)


def test_weekend_news_rolls_to_the_next_trading_day(spark):
    news = spark.createDataFrame(
        [("A", dt.datetime(2026, 1, 2, 12), 0.4, "negative"), ("A", dt.datetime(2026, 1, 3, 12), 0.8, "negative"), ("A", dt.datetime(2026, 1, 4, 12), 0.2, "neutral"), ("A", dt.datetime(2026, 1, 9, 12), 0.9, "negative"), ("B", dt.datetime(2026, 1, 2), 0.1, "neutral")],
        "ticker string, published_at timestamp, neg double, label string",
    )
    prices = spark.createDataFrame([("A", D(2026, 1, d), 100.0 + d) for d in (1, 2, 5, 6)], "ticker string, day date, close double")
    got = {r["day"].day: r for r in panel.build_features(news, prices, "UTC").collect()}
    assert set(got) == {2, 5}
    assert (got[5]["news_n"], got[5]["news_neg"], got[5]["neg_ratio"]) == (2, 0.5, 0.5)
    late = spark.createDataFrame([("A", dt.datetime(2026, 1, 3, 3), 0.5, "neutral")], news.schema)
    assert panel.calendar_features(late).first()["date"] == D(2026, 1, 2)


def test_zscores_of_constant_and_missing_values(spark):
    df = spark.createDataFrame([("A", float(k), 1.0, None) for k in range(8)] + [("B", 1.0, 1.0, 2.0)], "ticker string, x double, c double, n double")
    out = panel.zscores(df, columns=["x", "c", "n"]).collect()
    assert len(out) == 8 and all(r["z_c"] == 0 and r["z_n"] is None for r in out)
    assert sum(r["z_x"] ** 2 for r in out) / 8 == pytest.approx(1)


def test_csv_scans(spark, tmp_path):
    path = tmp_path / "prices.csv"
    path.write_text("ticker,date,open,high,low,close,adj_close,volume\nAAA,2026-01-02,1,2,0.5,1.5,1.5,100\n\nAAA,2026-01-01,1,2,0.5,1.2,1.2,90\n")
    assert [r["bars"] for r in readers.bar_counts(readers.price_csv(spark, str(path))).collect()] == [2]
    path.write_text("ticker,date,open,high,low,close,adj_close,volume\nAAA,2026-01-02,x,2,0.5,1.5,1.5,100\n")
    with pytest.raises(Exception):
        readers.price_csv(spark, str(path)).collect()
