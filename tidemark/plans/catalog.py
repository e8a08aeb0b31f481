"""All queries of the engine by name, and the SQL that must give the same rows.

Numbers that depend on the order of additions are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import expr, sentences, stats
from tidemark.functions import text as X
from tidemark.operators import anomaly, asof, backtest, evidence, explain, ingest, labels, limits, modelops, panel, pit, ranks, regime, validate
from tidemark.plans import surrogate as S
from tidemark.plans.catalog_streams import admitted_sql, shown
from tidemark.sources import readers, storage, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


def r6(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


def r9(*columns: str) -> list:
    return [F.round(c, 9).alias(c) for c in columns]


def r9_sql(*columns: str) -> str:
    return ", ".join(f"round({c}, 9) AS {c}" for c in columns)


def r6_sql(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


# ---- panels ----------------------------------------------------------------


def features(spark: SparkSession, sf: str) -> DataFrame:
    return panel.build_features(S.news(spark, sf), S.prices(spark, sf), zone="UTC")


def full_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Rounded to nine digits, so that equal days tie however their means were added up."""
    rows = panel.build_panel(S.news(spark, sf), S.prices(spark, sf), zone="UTC")
    return rows.withColumns({c: F.round(c, 9) for c in ("news_neg", "neg_ratio", "abs_ret")})


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return panel.severities(panel.zscores(features(spark, sf)))


_FEATURES = ("news_neg", "neg_ratio", "abs_ret")


@query("c01_company_day_features", S.with_(*S.BASE) + f"SELECT ticker, day, news_n, {r9_sql(*_FEATURES)} FROM features")
def c01(spark, sf):
    return features(spark, sf).select("ticker", "day", "news_n", *r9(*_FEATURES))


@query("c02_panel_forward_vol", S.with_(*S.BASE[:-1], S.PANEL) + f"SELECT ticker, day, news_n, {r9_sql(*_FEATURES)}, {r6_sql('fwd_vol')} FROM panel")
def c02(spark, sf):
    return full_panel(spark, sf).select("ticker", "day", "news_n", *r9(*_FEATURES), *r6("fwd_vol"))


_Z = tuple(f"z_{c}" for c in panel.FEATURES)


@query(
    "w04_zscore_severity",
    S.with_(*S.BASE, S.SCORED)
    + f"SELECT ticker, day, {r6_sql(*_Z, 'max_abs_z')}, CASE WHEN max_abs_z >= 4 THEN 'high' WHEN max_abs_z >= 3 THEN 'medium' ELSE 'low' END AS severity FROM scored",
)
def w04(spark, sf):
    return scored(spark, sf).orderBy(F.desc("max_abs_z"), "ticker", "day").select("ticker", "day", *r6(*_Z, "max_abs_z"), "severity")


@query(
    "a01_calendar_day_features",
    S.with_(S.NEWS)
    + """SELECT ticker, CAST(published_at - INTERVAL 5 HOUR AS DATE) AS date, count(*) AS news_n, round(avg(neg), 6) AS news_neg,
         round(avg(CASE WHEN label = 'negative' THEN 1.0 ELSE 0.0 END), 6) AS neg_ratio FROM news GROUP BY ALL""",
)
def a01(spark, sf):
    """New York's days; all events are in winter, five hours behind."""
    return panel.calendar_features(S.news(spark, sf))


@query(
    "j03_asof_trades_of_events",
    """WITH e AS (SELECT event_id, user_id % 7 AS k, ts FROM events), t AS (SELECT user_id % 7 AS k, ts, event_id AS next_id FROM events WHERE event_type = 'purchase')
       SELECT e.event_id, t.next_id FROM e ASOF LEFT JOIN (SELECT k, ts, min(next_id) AS next_id FROM t GROUP BY k, ts) t ON e.k = t.k AND e.ts <= t.ts""",
)
def j03_events(spark, sf):
    """The next purchase of a group of users after each event: few keys with very many rows."""
    rows = S.table(spark, sf, "events").select("event_id", (F.col("user_id") % 7).alias("k"), "ts", "event_type")
    bought = rows.where("event_type = 'purchase'").select("k", F.col("ts").alias("at"), F.col("event_id").alias("next_id"))
    return asof.asof(rows.select("event_id", "k", "ts"), bought, "k", "ts", "at", ["next_id"], how="left", days=1, parts=4).select("event_id", "next_id")


@query(
    "j04_asof_last_bar",
    S.with_(S.LONG)
    + """SELECT f.o_orderkey AS id, b.date, b.close FROM (SELECT o_orderkey, c_mktsegment AS ticker, CAST(o_orderdate AS DATE) - 400 AS at FROM orders JOIN customer ON c_custkey = o_custkey) f
         ASOF LEFT JOIN bars b ON f.ticker = b.ticker AND f.at >= b.date""",
)
def j04_last(spark, sf):
    """The last close known 400 days before each order."""
    names = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("ticker"))
    orders = S.table(spark, sf, "orders").join(names, "o_custkey")
    cutoffs = orders.select(F.col("o_orderkey").alias("id"), "ticker", F.date_sub(F.to_date("o_orderdate"), 400).alias("at"))
    return pit.PointInTime(S.long_prices(spark, sf)).last_before(cutoffs, "at", ["date", "close"]).select("id", "date", "close")


@query("j03_asof_forward_roll", S.with_(S.NEWS, S.PRICES, S.ROLLED) + "SELECT ticker, day, count(*) AS articles FROM rolled GROUP BY ALL")
def j03(spark, sf):
    days = panel.news_days(S.news(spark, sf), "UTC")
    return panel.roll_forward(days, S.prices(spark, sf)).groupBy("ticker", "day").agg(F.sum("n").alias("articles"))


@query("w01_log_returns", S.with_(S.PRICES, S.RETURNS) + "SELECT ticker, day, round(ret, 6) AS ret FROM rets")
def w01(spark, sf):
    return S.prices(spark, sf).select("ticker", "day", F.round(panel.log_return("ticker"), 6).alias("ret"))


@query("a22_top50_by_articles", S.with_(*S.BASE[:-1], S.PANEL) + "SELECT ticker, sum(news_n)::BIGINT AS articles FROM panel GROUP BY ticker ORDER BY articles DESC, ticker LIMIT 50")
def a22(spark, sf):
    return panel.top_tickers(full_panel(spark, sf))


@query(
    "j14_well_covered",
    S.with_(*S.BASE[:-1], S.PANEL, "best AS (SELECT ticker, sum(news_n) AS a FROM panel GROUP BY ticker ORDER BY a DESC, ticker LIMIT 50)")
    + "SELECT ticker, day, news_n FROM panel WHERE ticker IN (SELECT ticker FROM best)",
)
def j14(spark, sf):
    return panel.well_covered(full_panel(spark, sf)).select("ticker", "day", "news_n")


@query(
    "a23_decile_bins",
    S.with_(
        *S.BASE[:-1],
        S.PANEL,
        "rows AS (SELECT round(news_neg, 9) AS x, round(abs_ret, 9) AS y FROM panel WHERE abs_ret IS NOT NULL)",
        "edges AS (SELECT DISTINCT unnest(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS e FROM rows)",
        "binned AS (SELECT x, y, greatest((SELECT count(*) FROM edges WHERE e < x), 1) - 1 AS bin FROM rows)",
    )
    + "SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y FROM binned GROUP BY bin",
)
def a23(spark, sf):
    return panel.decile_bins(full_panel(spark, sf), "news_neg", "abs_ret").select("bin", "n", *r6("mean_x", "mean_y"))


# ---- rank statistics -------------------------------------------------------

_RANK = "(rank() OVER ({0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {2}{1}) - 1) / 2.0)"


def rank_sql(column: str, key: str = "") -> str:
    return _RANK.format(f"PARTITION BY {key}" if key else "", column, f"{key}, " if key else "")


def _pairs(x: str, y: str, source: str = "panel", key: str = "ticker") -> str:
    return f"pairs AS (SELECT {key}, round({x}, 9) AS x, round({y}, 9) AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"


@query(
    "a16_pooled_spearman",
    S.with_(*S.BASE[:-1], S.PANEL, _pairs("news_neg", "abs_ret"), f"r AS (SELECT {rank_sql('x')} AS rx, {rank_sql('y')} AS ry FROM pairs)")
    + "SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r",
)
def a16(spark, sf):
    return ranks.spearman(full_panel(spark, sf), "news_neg", "abs_ret").select(*r6("rho"), "n")


_RHO_BY = (
    f"r AS (SELECT ticker, {rank_sql('x', 'ticker')} AS rx, {rank_sql('y', 'ticker')} AS ry FROM pairs)",
    """rhos AS (SELECT ticker, corr(rx, ry) AS rho, count(*) AS n FROM r GROUP BY ticker
       HAVING count(*) >= 8 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0)""",
)


@query("a17_per_company_spearman", S.with_(*S.BASE[:-1], S.PANEL, _pairs("news_neg", "abs_ret"), *_RHO_BY) + "SELECT ticker, round(rho, 6) AS rho, n FROM rhos")
def a17(spark, sf):
    return ranks.spearman_by(full_panel(spark, sf), "ticker", "news_neg", "abs_ret").select("ticker", *r6("rho"), "n")


@query(
    "a17_spearman_summary",
    S.with_(*S.BASE[:-1], S.PANEL, _pairs("news_neg", "abs_ret"), *_RHO_BY)
    + "SELECT round(median(rho), 6) AS median_rho, round(avg(CASE WHEN round(rho, 9) > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_positive, count(*) AS companies FROM rhos",
)
def a17_summary(spark, sf):
    each = ranks.spearman_by(full_panel(spark, sf), "ticker", "news_neg", "abs_ret")
    return each.agg(F.round(F.median("rho"), 6).alias("median_rho"), F.round(F.avg((F.round("rho", 9) > 0).cast("double")), 6).alias("share_positive"), F.count("*").alias("companies"))


@query(
    "a21_coverage_sweep",
    S.with_(
        *S.BASE[:-1],
        S.PANEL,
        "each AS (SELECT t.min_n, panel.* FROM panel, (VALUES (1), (3), (5), (10), (20)) t(min_n) WHERE news_n >= t.min_n)",
        "counts AS (SELECT min_n, count(*) AS days, count(DISTINCT ticker) AS companies FROM each GROUP BY min_n)",
        "each9 AS (SELECT min_n, ticker, round(news_neg, 9) AS news_neg, round(abs_ret, 9) AS abs_ret FROM each)",
        f"""zs AS (SELECT min_n, round({S.z("news_neg", "PARTITION BY min_n, ticker")}, 9) AS x, round({S.z("abs_ret", "PARTITION BY min_n, ticker")}, 9) AS y FROM each9)""",
        f"r AS (SELECT min_n, {rank_sql('x', 'min_n')} AS rx, {rank_sql('y', 'min_n')} AS ry FROM zs WHERE x IS NOT NULL AND y IS NOT NULL)",
        "rhos AS (SELECT min_n, corr(rx, ry) AS rho FROM r GROUP BY min_n HAVING stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 AND count(*) >= 5)",
    )
    + """SELECT c.min_n, days, companies, CASE WHEN days >= 30 AND companies >= 5 THEN round(rho, 4) END AS rho
         FROM counts c LEFT JOIN rhos r ON c.min_n = r.min_n""",
)
def a21(spark, sf):
    return ranks.coverage_sweep(full_panel(spark, sf)).withColumn("rho", F.round("rho", 4))


#: Steps of Simpson's rule for p-values in SQL.
_STEPS = 4000


def _simpson(upto: str, density: str) -> str:
    """The integral from 0 to ``upto`` of a density of u."""
    weights = f"(CASE WHEN k = 0 OR k = {_STEPS} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)"
    return f"({upto}) / {3 * _STEPS}.0 * list_sum([{weights} * {density.replace('u', f'(({upto}) * k / {_STEPS}.0)')} FOR k IN range({_STEPS + 1})])"


def t_sql(rho: str, n: str) -> str:
    """The two-sided p of a rank correlation by Student's t, integrated."""
    t = f"(abs({rho}) * sqrt(({n} - 2) / (1 - {rho} * {rho})))"
    area = _simpson(t, f"pow(1 + u * u / ({n} - 2), -({n} - 1) / 2.0)")
    scale = f"exp(lgamma(({n} - 1) / 2.0) - lgamma(({n} - 2) / 2.0)) / sqrt(pi() * ({n} - 2))"
    return f"CASE WHEN {rho} IS NULL OR {n} < 3 THEN NULL WHEN abs({rho}) >= 1 THEN 0.0 ELSE greatest(0.0, 1 - 2 * {scale} * {area}) END"


def normal_sql(z: str) -> str:
    """The two-sided p of a normal deviate, integrated."""
    return f"CASE WHEN ({z}) <= 0 THEN 1.0 ELSE greatest(0.0, 1 - 2 / sqrt(2 * pi()) * {_simpson(z, 'exp(-u * u / 2)')}) END"


_BLOCKS = [
    ("co-movement: sentiment", "news_neg", "abs_ret", "TRUE"),
    ("co-movement: volume", "news_n", "abs_ret", "TRUE"),
    ("lead: sentiment", "news_neg", "fwd_vol", "fwd_vol IS NOT NULL"),
    ("lead: volume", "news_n", "fwd_vol", "fwd_vol IS NOT NULL"),
    ("well covered: sentiment", "news_neg", "abs_ret", "ticker IN (SELECT ticker FROM best)"),
    ("well covered: volume", "news_n", "abs_ret", "ticker IN (SELECT ticker FROM best)"),
]


@query(
    "c07_panel_study",
    S.with_(
        *S.BASE[:-1],
        S.PANEL,
        "best AS (SELECT ticker, sum(news_n) AS a FROM panel GROUP BY ticker ORDER BY a DESC, ticker LIMIT 50)",
        "panel9 AS (SELECT ticker, news_n, round(news_neg, 9) AS news_neg, round(abs_ret, 9) AS abs_ret, round(fwd_vol, 9) AS fwd_vol FROM panel)",
        "blocks AS (" + " UNION ALL ".join(f"SELECT '{t}' AS title, ticker, {x}::DOUBLE AS x, {y}::DOUBLE AS y FROM panel9 WHERE {w}" for t, x, y, w in _BLOCKS) + ")",
        f"zs AS (SELECT title, round({S.z('x', 'PARTITION BY title, ticker')}, 9) AS x, round({S.z('y', 'PARTITION BY title, ticker')}, 9) AS y FROM blocks)",
        """pairs AS (SELECT title, 'pooled' AS metric, '' AS ticker, x, y FROM blocks UNION ALL SELECT title, 'within', '', x, y FROM zs
                     UNION ALL SELECT title, 'each', ticker, x, y FROM blocks)""",
        f"r AS (SELECT title, metric, ticker, {rank_sql('x', 'title, metric, ticker')} AS rx, {rank_sql('y', 'title, metric, ticker')} AS ry FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL)",
        """rho AS (SELECT title, metric, ticker, CASE WHEN count(*) >= 5 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS rho, count(*) AS n
                   FROM r GROUP BY ALL)""",
        """each AS (SELECT title, median(rho) AS m, avg(CASE WHEN rho > 1e-12 THEN 1.0 ELSE 0.0 END) AS s, count(*) AS n
                    FROM rho WHERE metric = 'each' AND n >= 8 AND rho IS NOT NULL GROUP BY title)""",
        f"""found AS (SELECT title, metric, rho, {t_sql('rho', 'n')} AS p, n FROM rho WHERE metric <> 'each'
                      UNION ALL SELECT title, 'median', m, NULL, n FROM each UNION ALL SELECT title, 'share_positive', s, NULL, n FROM each)""",
    )
    + f"SELECT title, metric, {r6_sql('rho', 'p')}, n FROM found",
)
def c07(spark, sf):
    rows = full_panel(spark, sf).withColumn("fwd_vol", F.round("fwd_vol", 9))
    return ranks.analyze_panel(rows).select("title", "metric", *r6("rho", "p"), "n")


# ---- labels and validation -------------------------------------------------

_LABELLED = (
    S.LONG,
    S.FILINGS,
    """vols AS (
        SELECT f.filing_id, f.filed_date, b.date, ln(b.close) - lag(ln(b.close)) OVER (PARTITION BY f.filing_id ORDER BY b.date) AS r
        FROM filings f JOIN bars b ON f.ticker = b.ticker AND b.date > f.filed_date AND b.date <= f.filed_date + 30 WHERE b.close > 0)""",
    """realized AS (
        SELECT f.filing_id, CASE WHEN count(r) >= 10 THEN stddev_samp(r) * sqrt(252) END AS realized_vol,
               CASE WHEN count(r) >= 10 THEN min(v.date) END AS window_start, CAST(any_value(f.filed_date) + 30 AS DATE) AS window_end, CAST(count(r) AS INTEGER) AS n_returns
        FROM filings f LEFT JOIN vols v ON f.filing_id = v.filing_id GROUP BY f.filing_id)""",
    "cuts AS (SELECT quantile_cont(realized_vol, 1.0 / 3) AS lo, quantile_cont(realized_vol, 2.0 / 3) AS hi FROM realized)",
    """labelled AS (SELECT realized.*, CASE WHEN realized_vol <= lo THEN 'low' WHEN realized_vol <= hi THEN 'medium' WHEN realized_vol IS NOT NULL THEN 'high' END AS vol_label
        FROM realized, cuts)""",
    "study AS (SELECT f.*, round(l.realized_vol, 9) AS realized_vol, l.vol_label FROM filings f JOIN labelled l ON f.filing_id = l.filing_id WHERE l.realized_vol IS NOT NULL)",
)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_filings(S.filings(spark, sf), S.long_prices(spark, sf).withColumnRenamed("date", "day"))


def study(spark: SparkSession, sf: str) -> DataFrame:
    known = labelled(spark, sf).where("realized_vol is not null").select("filing_id", *r9("realized_vol"), "vol_label")
    return S.filings(spark, sf).join(known, "filing_id")


@query("c04_realized_vol_labels", S.with_(*_LABELLED) + "SELECT filing_id, round(realized_vol, 6) AS realized_vol, window_start, window_end, n_returns, vol_label FROM labelled")
def c04(spark, sf):
    return labelled(spark, sf).select("filing_id", *r6("realized_vol"), "window_start", "window_end", "n_returns", "vol_label")


@query("a13_label_counts", S.with_(*_LABELLED) + "SELECT coalesce(vol_label, 'null') AS vol_label, count(*) AS n FROM labelled GROUP BY 1")
def a13(spark, sf):
    return labels.label_counts(labelled(spark, sf))


@query("a07_terciles", S.with_(*_LABELLED) + "SELECT round(lo, 6) AS tercile_low, round(hi, 6) AS tercile_high FROM cuts")
def a07(spark, sf):
    return labels.terciles(labelled(spark, sf)).select(*r6("tercile_low", "tercile_high"))


_CHANGES = """changes AS (
    SELECT * FROM (
        SELECT filing_id, ticker, realized_vol, mean_negative - lag(mean_negative) OVER w AS d_mean_negative,
               realized_vol - lag(realized_vol) OVER w AS d_realized_vol, filed_date - lag(filed_date) OVER w AS gap_days
        FROM study WINDOW w AS (PARTITION BY ticker ORDER BY filed_date, filing_id)) WHERE d_mean_negative IS NOT NULL AND d_realized_vol IS NOT NULL)"""


def changes(spark: SparkSession, sf: str) -> DataFrame:
    return validate.build_changes(study(spark, sf))


@query("w06_yoy_changes", S.with_(*_LABELLED, _CHANGES) + "SELECT filing_id, round(d_mean_negative, 6) + 0.0 AS d_mean_negative, round(d_realized_vol, 6) + 0.0 AS d_realized_vol, CAST(gap_days AS INTEGER) AS gap_days FROM changes")
def w06(spark, sf):
    return changes(spark, sf).select("filing_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("d_mean_negative", "d_realized_vol")], "gap_days")


@query(
    "f14_change_summary",
    S.with_(*_LABELLED, _CHANGES)
    + "SELECT count(*) AS n, count(DISTINCT ticker) AS companies, median(gap_days) AS median_gap, count(*) FILTER (WHERE gap_days < 200 OR gap_days > 500) AS off_cycle FROM changes",
)
def f14(spark, sf):
    return validate.change_summary(changes(spark, sf))


@query(
    "a20_rose_fell_split",
    S.with_(*_LABELLED, _CHANGES)
    + """SELECT CASE WHEN d_mean_negative > 0 THEN 'rose' ELSE 'fell' END AS direction, count(*) AS n, round(median(realized_vol), 6) AS median_vol,
         round(median(d_realized_vol), 6) AS median_d_vol FROM changes GROUP BY 1""",
)
def a20(spark, sf):
    return validate.rose_fell(changes(spark, sf)).select("direction", "n", *r6("median_vol", "median_d_vol"))


@query(
    "a18_kruskal_h",
    S.with_(
        *_LABELLED,
        f"r AS (SELECT vol_label AS g, {rank_sql('mean_negative')} AS r, count(*) OVER (PARTITION BY mean_negative) AS t FROM study)",
        "sums AS (SELECT g, sum(r) AS s, count(*) AS k, sum(t * t - 1) AS t FROM r GROUP BY g)",
        "one AS (SELECT sum(s * s / k) AS q, sum(k)::DOUBLE AS n, sum(t)::DOUBLE AS t, count(*) AS groups FROM sums)",
    )
    + "SELECT round((12 * q / (n * (n + 1)) - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 6) AS h, groups, CAST(n AS BIGINT) AS n FROM one",
)
def a18(spark, sf):
    return ranks.kruskal(study(spark, sf), "mean_negative", "vol_label").select(*r6("h"), "groups", "n")


@query(
    "a19_mann_whitney_u",
    S.with_(*_LABELLED, _CHANGES, f"r AS (SELECT d_mean_negative > 0 AS g, {rank_sql('realized_vol')} AS r FROM changes)")
    + "SELECT sum(r) FILTER (WHERE g) - count(*) FILTER (WHERE g) * (count(*) FILTER (WHERE g) + 1) / 2.0 AS u, count(*) FILTER (WHERE g) AS n1, count(*) FILTER (WHERE NOT g) AS n2 FROM r",
)
def a19(spark, sf):
    return ranks.mann_whitney(changes(spark, sf), "realized_vol", F.col("d_mean_negative") > 0).select("u", "n1", "n2")


_MEANS = ["mean_negative", "risk_density", "n_sentences", "max_negative"]


@query(
    "a04_sector_rollup",
    S.with_(*_LABELLED) + "SELECT ticker AS sector, count(*) AS n, round(avg(mean_negative), 6) AS mean_neg, round(avg(realized_vol), 6) AS mean_vol FROM study GROUP BY ticker",
)
def a04(spark, sf):
    return validate.sector_view(study(spark, sf).withColumn("sector", F.col("ticker"))).select("sector", "n", *r6("mean_neg", "mean_vol"))


@query(
    "a05_company_average",
    S.with_(*_LABELLED) + f"SELECT company AS ticker, min(ticker) AS sector, round(avg(realized_vol), 6) AS realized_vol, {', '.join(f'round(avg({c}), 11) AS {c}' for c in _MEANS)} FROM study GROUP BY company",
)
def a05(spark, sf):
    rows = study(spark, sf).withColumnRenamed("ticker", "sector").withColumnRenamed("company", "ticker")
    return validate.company_averages(rows, _MEANS).select("ticker", "sector", *r6("realized_vol"), *[F.round(c, 11).alias(c) for c in _MEANS])


@query(
    "a06_bucket_means",
    S.with_(
        *_LABELLED,
        "long AS (" + " UNION ALL ".join(f"SELECT vol_label, '{c}' AS feature, {c}::DOUBLE AS v FROM study" for c in _MEANS) + ")",
        "wide AS (SELECT feature, " + ", ".join(f"avg(v) FILTER (WHERE vol_label = '{b}') AS {b}" for b in ("low", "medium", "high")) + " FROM long GROUP BY feature)",
    )
    + f"SELECT feature, {r6_sql('low', 'medium', 'high')}, CASE WHEN high > low THEN 'UP' ELSE 'DOWN' END AS trend FROM wide",
)
def a06(spark, sf):
    return validate.bucket_means(study(spark, sf), _MEANS).select("feature", *r6("low", "medium", "high"), "trend")


@query("f07_confident_filings", S.with_(*_LABELLED) + "SELECT filing_id FROM study WHERE coalesce(n_sentences, 0) >= 50")
def f07(spark, sf):
    return validate.confident(study(spark, sf)).select("filing_id")


_C05 = {"mean_negative": "mean_negative", "max_negative": "max_negative", "risk_density": "risk_density", "mean_neutral": "risk_density", "mean_positive": "1 - mean_negative"}


@query(
    "c05_signal_validation",
    S.with_(
        *_LABELLED,
        "wide AS (SELECT 'all' AS block, * FROM study UNION ALL SELECT 'confident', * FROM study WHERE n_sentences >= 50 UNION ALL SELECT 'ex_financials', * FROM study WHERE NOT contains(lower(ticker), 'financ'))",
        "long AS ("
        + " UNION ALL ".join(f"SELECT block, '{f}' AS feature, ({c})::DOUBLE AS x, realized_vol AS y, vol_label FROM wide" for f, c in _C05.items())
        + """ UNION ALL SELECT 'company_average', 'mean_negative', avg(mean_negative), avg(realized_vol), NULL FROM study GROUP BY ticker)""",
        f"r AS (SELECT *, {rank_sql('x', 'block, feature')} AS rx, {rank_sql('y', 'block, feature')} AS ry, count(*) OVER (PARTITION BY block, feature, x) AS t FROM long)",
        """rho AS (SELECT block, feature, count(*) AS n, CASE WHEN count(*) >= 5 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS rho,
                          avg(x) FILTER (WHERE vol_label = 'low') AS low, avg(x) FILTER (WHERE vol_label = 'medium') AS medium, avg(x) FILTER (WHERE vol_label = 'high') AS high
                   FROM r GROUP BY ALL)""",
        "sums AS (SELECT block, feature, vol_label, sum(rx) AS s, count(*) AS k, sum(t * t - 1) AS t FROM r WHERE vol_label IS NOT NULL GROUP BY ALL)",
        "one AS (SELECT block, feature, sum(s * s / k) AS q, sum(k)::DOUBLE AS m, sum(t)::DOUBLE AS t, count(*) AS g FROM sums GROUP BY ALL)",
        "h AS (SELECT block, feature, g, (12 * q / (m * (m + 1)) - 3 * (m + 1)) / (1 - t / (m * m * m - m)) AS h FROM one WHERE g >= 2)",
        f"""found AS (
            SELECT rho.block, rho.feature, rho, {t_sql('rho', 'n')} AS p, n, h, CASE WHEN g = 3 THEN exp(-h / 2) WHEN g = 2 THEN {normal_sql('sqrt(h)')} END AS h_p, low, medium, high,
                   CASE WHEN rho.block <> 'company_average' THEN CASE WHEN high > low THEN 'UP' ELSE 'DOWN' END END AS trend, NULL::DOUBLE AS mean_neg, NULL::DOUBLE AS mean_vol
            FROM rho LEFT JOIN h ON h.block = rho.block AND h.feature = rho.feature
            UNION ALL SELECT 'sector', ticker, NULL, NULL, count(*), NULL, NULL, NULL, NULL, NULL, NULL, avg(mean_negative), avg(realized_vol) FROM study GROUP BY ticker)""",
    )
    + f"SELECT block, feature, n, trend, {r6_sql('rho', 'p', 'h', 'h_p', 'low', 'medium', 'high', 'mean_neg', 'mean_vol')} FROM found",
)
def c05(spark, sf):
    rows = study(spark, sf).withColumns({"sector": F.col("ticker"), "mean_neutral": F.col("risk_density"), "mean_positive": 1 - F.col("mean_negative")})
    numbers = r6("rho", "p", "h", "h_p", "low", "medium", "high", "mean_neg", "mean_vol")
    return validate.analyze(rows).select("block", "feature", "n", "trend", *numbers)


_MOVED = """moved AS (
    SELECT round(d_mean_negative, 12) AS d_mean_negative, round(d_risk_density, 12) AS d_risk_density, d_n_sentences,
           realized_vol, round(d_realized_vol, 9) AS d_realized_vol
    FROM (
        SELECT realized_vol, mean_negative - lag(mean_negative) OVER w AS d_mean_negative, risk_density - lag(risk_density) OVER w AS d_risk_density,
               n_sentences - lag(n_sentences) OVER w AS d_n_sentences, realized_vol - lag(realized_vol) OVER w AS d_realized_vol
        FROM study WINDOW w AS (PARTITION BY ticker ORDER BY filed_date, filing_id)) WHERE d_mean_negative IS NOT NULL AND d_realized_vol IS NOT NULL)"""
_YS = ("realized_vol", "d_realized_vol")


@query(
    "c06_change_validation",
    S.with_(
        *_LABELLED,
        _MOVED,
        "pairs AS (" + " UNION ALL ".join(f"SELECT '{f}' AS x, '{y}' AS y, {f}::DOUBLE AS a, {y} AS b FROM moved" for f in validate.CHANGES for y in _YS) + ")",
        f"r AS (SELECT x, y, {rank_sql('a', 'x, y')} AS ra, {rank_sql('b', 'x, y')} AS rb FROM pairs)",
        "rho AS (SELECT x, y, corr(ra, rb) AS rho, count(*) AS n FROM r GROUP BY ALL)",
        "sides AS (" + " UNION ALL ".join(f"SELECT '{y}' AS y, d_mean_negative > 0 AS rose, {y} AS v FROM moved" for y in _YS) + ")",
        f"ranked AS (SELECT y, rose, {rank_sql('v', 'y')} AS r, count(*) OVER (PARTITION BY y, v) AS t FROM sides)",
        """u AS (SELECT y, sum(r) FILTER (WHERE rose) - n1 * (n1 + 1) / 2.0 AS u, n1, n2, sum(t * t - 1)::DOUBLE AS ties
                 FROM ranked JOIN (SELECT y, count(*) FILTER (WHERE rose) AS n1, count(*) FILTER (WHERE NOT rose) AS n2 FROM ranked GROUP BY y) USING (y) GROUP BY y, n1, n2)""",
        """z AS (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS z FROM u)""",
        f"""found AS (SELECT 'spearman' AS test, x, y, rho AS statistic, {t_sql('rho', 'n')} AS p, n FROM rho
                      UNION ALL SELECT 'mann_whitney', 'rose', y, u, {normal_sql('z')}, n1 + n2 FROM z)""",
    )
    + f"SELECT test, x, y, {r6_sql('statistic', 'p')}, n FROM found",
)
def c06(spark, sf):
    """Differences are rounded, so that equal ones tie."""
    rounded = {"d_mean_negative": 12, "d_risk_density": 12, "d_realized_vol": 9}
    rows = changes(spark, sf).withColumns({c: F.round(c, k) for c, k in rounded.items()})
    return validate.analyze_change(rows).select("test", "x", "y", *r6("statistic", "p"), "n")


# ---- alerts and evidence ---------------------------------------------------

_ALERTS = (S.COMPANIES, *S.BASE, S.SCORED, S.ALERTS)


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    names = S.companies(spark, sf).select(F.col("id").alias("company_id"), "ticker")
    rows = scored(spark, sf).where("max_abs_z >= 1.8").join(names, "ticker")
    return rows.select(
        (F.col("company_id") * 100 + F.dayofmonth("day")).alias("id"),
        "company_id",
        F.col("day").cast("timestamp").alias("triggered_at"),
        F.lit(anomaly.ALERT_TYPE).alias("alert_type"),
        "severity",
        F.lit("unusual").alias("explanation"),
        F.lit(False).alias("resolved"),
    )


def explanations(spark: SparkSession, sf: str) -> DataFrame:
    """An explanation for every third alert."""
    return alerts(spark, sf).where("id % 3 = 0").select(F.col("id").alias("alert_id"), F.lit("generated").alias("status"), F.lit("told [id=1]").alias("narrative"), F.array(F.lit(1)).alias("cited_ids"))


_EVIDENCE = """evidence AS (
    SELECT a.alert_id, n.article_id, n.neg, n.headline, row_number() OVER (PARTITION BY a.alert_id ORDER BY n.neg DESC NULLS LAST, n.article_id) AS rank
    FROM alerts a JOIN news n ON n.company_id = a.company_id AND n.pub_day = a.day)"""


@query("j08_evidence_topk", S.with_(*_ALERTS, _EVIDENCE) + "SELECT alert_id, CAST(rank AS INTEGER) AS rank, article_id, headline, round(neg, 6) AS sentiment_score FROM evidence WHERE rank <= 5")
def j08(spark, sf):
    out = evidence.headlines(alerts(spark, sf), S.articles(spark, sf), S.links(spark, sf))
    return out.select("alert_id", "rank", "article_id", "headline", *r6("sentiment_score"))


@query(
    "c20_alert_feed",
    S.with_(*_ALERTS)
    + """SELECT a.alert_id, a.company_id, c.ticker, c.name, a.day, a.severity FROM alerts a JOIN companies c ON c.id = a.company_id
         ORDER BY CASE a.severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, a.day DESC, a.alert_id LIMIT 50""",
)
def c20(spark, sf):
    feed = evidence.alert_feed(alerts(spark, sf), S.companies(spark, sf))
    return feed.select("alert_id", "company_id", "ticker", "name", F.to_date("triggered_at").alias("day"), "severity")


@query(
    "f03_filtered_feed",
    S.with_(*_ALERTS)
    + """SELECT a.alert_id, c.ticker, a.severity FROM alerts a JOIN companies c ON c.id = a.company_id WHERE a.severity = 'low'
         AND c.ticker = (SELECT min(ticker) FROM alerts WHERE severity = 'low') ORDER BY a.day DESC, a.alert_id LIMIT 200""",
)
def f03(spark, sf):
    rows = alerts(spark, sf)
    names = S.companies(spark, sf)
    first = rows.where("severity = 'low'").join(names, rows["company_id"] == names["id"]).agg(F.min("ticker")).first()[0]
    return evidence.alert_feed(rows, names, " LOW ", first.lower() if first else None, 1000).select("alert_id", "ticker", "severity")


@query(
    "c21_risk_detail",
    S.with_(*_ALERTS, _EVIDENCE, "top AS (SELECT ticker FROM alerts GROUP BY ticker ORDER BY count(*) DESC, ticker LIMIT 1)")
    + """SELECT a.company_id, a.ticker, a.alert_id, a.day, a.severity, CASE WHEN a.alert_id % 3 = 0 THEN 'generated' END AS explanation_status,
         (SELECT string_agg(article_id::VARCHAR, ',' ORDER BY rank) FROM evidence e WHERE e.alert_id = a.alert_id AND rank <= 5) AS article_ids
         FROM alerts a WHERE a.ticker IN (SELECT ticker FROM top)""",
)
def c21(spark, sf):
    rows, names = alerts(spark, sf), S.companies(spark, sf)
    top = rows.join(names.select(F.col("id").alias("company_id"), "ticker"), "company_id").groupBy("ticker").count().orderBy(F.desc("count"), "ticker").first()
    detail = evidence.risk_detail(names, rows, S.articles(spark, sf), S.links(spark, sf), explanations(spark, sf), top["ticker"] if top else "")
    flat = detail.select("company_id", "ticker", F.explode("alerts").alias("a"))
    ids = F.array_join(F.transform("a.headlines", lambda h: h["article_id"].cast("string")), ",")
    return flat.select(
        "company_id", "ticker", "a.alert_id", F.to_date("a.triggered_at").alias("day"), "a.severity", F.col("a.explanation.status").alias("explanation_status"), F.when(F.col("a.headlines").isNotNull(), ids).alias("article_ids")
    )


@query("j10_demo_extract", S.with_(*_ALERTS) + "SELECT DISTINCT article_id, headline FROM news n WHERE EXISTS (SELECT 1 FROM alerts a WHERE a.company_id = n.company_id AND a.day = n.pub_day)")
def j10(spark, sf):
    return evidence.alert_news(S.articles(spark, sf), S.links(spark, sf), alerts(spark, sf)).select(F.col("id").alias("article_id"), "headline")


@query("a12_severity_counts", S.with_(*_ALERTS) + "SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low FROM alerts")
def a12(spark, sf):
    return anomaly.severity_counts(alerts(spark, sf))


@query("j09_alert_explanations", S.with_(*_ALERTS) + "SELECT alert_id, CASE WHEN alert_id % 3 = 0 THEN 'generated' END AS status FROM alerts")
def j09(spark, sf):
    told = explanations(spark, sf).select("alert_id", "status").distinct()
    return alerts(spark, sf).select(F.col("id").alias("alert_id")).join(told, "alert_id", "left")


@query("f13_unexplained_alerts", S.with_(*_ALERTS) + "SELECT alert_id FROM alerts WHERE alert_id % 3 <> 0")
def f13(spark, sf):
    return evidence.unexplained(alerts(spark, sf), explanations(spark, sf)).select(F.col("id").alias("alert_id"))


@query("c03_isolation_forest")
def c03(spark, sf):
    out = anomaly.run_detection(features(spark, sf), trees=100)
    return out.select("ticker", "day", *r6("score", "max_abs_z"), "severity", "explanation")


# ---- sinks -----------------------------------------------------------------


@query(
    "k03_article_upsert",
    """WITH t AS (SELECT props AS url, event_id AS seq, event_type AS headline, value AS body FROM events),
       old AS (SELECT url, arg_min(headline, seq) AS headline, arg_min(body, seq) AS body FROM t WHERE seq % 2 = 0 GROUP BY url),
       new AS (SELECT url, arg_max(headline, seq) AS last_headline, arg_min(body, seq) AS first_body FROM t WHERE seq % 2 = 1 GROUP BY url)
       SELECT url, coalesce(last_headline, headline) AS headline, CASE WHEN old.url IS NOT NULL THEN body ELSE first_body END AS body FROM old FULL JOIN new USING (url)""",
)
def k03(spark, sf):
    rows = S.table(spark, sf, "events").select(F.col("props").alias("url"), F.col("event_id").alias("seq"), F.col("event_type").alias("headline"), F.col("value").alias("body"))
    old = rows.where("seq % 2 = 0").groupBy("url").agg(F.min_by("headline", "seq").alias("headline"), F.min_by("body", "seq").alias("body"))
    return writers.upsert_articles(old, rows.where("seq % 2 = 1"))


@query(
    "k05_price_upsert",
    """WITH t AS (SELECT user_id AS company_id, CAST(ts AS DATE) AS date, event_id AS seq, value AS close FROM events)
       SELECT company_id, date, arg_max(close, (seq % 2) * 100000000 + seq) AS close FROM t GROUP BY ALL""",
)
def k05(spark, sf):
    rows = S.table(spark, sf, "events").select(F.col("user_id").alias("company_id"), F.to_date("ts").alias("date"), F.col("event_id").alias("seq"), F.col("value").alias("close"))
    old = rows.where("seq % 2 = 0").groupBy("company_id", "date").agg(F.max_by("close", "seq").alias("close"))
    return writers.upsert_prices(old, rows.where("seq % 2 = 1"))


@query("k04_link_dedup", "SELECT DISTINCT event_id % 997 AS article_id, user_id AS company_id FROM events")
def k04(spark, sf):
    rows = S.table(spark, sf, "events").select((F.col("event_id") % 997).alias("article_id"), F.col("user_id").alias("company_id"), "event_id")
    return writers.insert_links(rows.where("event_id % 2 = 0").drop("event_id").distinct(), rows.where("event_id % 2 = 1"))


@query(
    "k01_company_upsert",
    """WITH c AS (SELECT c_nationkey AS cik, c_custkey AS seq, c_name AS ticker, c_mktsegment AS sector FROM customer),
       old AS (SELECT cik, arg_min(ticker, seq) AS ticker, arg_min(sector, seq) AS sector FROM c WHERE seq % 3 = 0 GROUP BY cik),
       new AS (SELECT cik, arg_min(ticker, seq) AS t, arg_max(sector, seq) AS s FROM c WHERE seq % 3 <> 0 GROUP BY cik)
       SELECT cik, coalesce(ticker, t) AS ticker, coalesce(s, sector) AS sector FROM old FULL JOIN new USING (cik)""",
)
def k01(spark, sf):
    rows = S.table(spark, sf, "customer").select(F.col("c_nationkey").alias("cik"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("ticker"), F.col("c_mktsegment").alias("sector"))
    old = rows.where("seq % 3 = 0").groupBy("cik").agg(F.min_by("ticker", "seq").alias("ticker"), F.min_by("sector", "seq").alias("sector"))
    return writers.upsert_companies(old, rows.where("seq % 3 <> 0"))


@query("u03_feed_dedup", "SELECT props AS url, min(event_id) AS seq, arg_min(event_type, event_id) AS headline FROM events GROUP BY props")
def u03(spark, sf):
    rows = S.table(spark, sf, "events").select(F.col("props").alias("url"), F.col("event_id").alias("seq"), F.col("event_type").alias("headline"))
    return ingest.first_of_feed(rows)


@query("f12_unscored_antijoin", "SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)")
def f12(spark, sf):
    scores = S.table(spark, sf, "labels").select(F.col("doc_id").alias("filing_id"), F.when(F.col("quality") == 1, "v1").otherwise("v0").alias("model_version"))
    return evidence.unscored(S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"), scores, "v1")


@query(
    "k16_sector_update",
    "SELECT c_custkey AS id, c_name AS ticker, CASE WHEN c_custkey % 10 = 0 THEN 'ENERGY' ELSE c_mktsegment END AS sector FROM customer",
)
def k16(spark, sf):
    names = S.companies(spark, sf).select("id", "ticker", "sector")
    return writers.set_sectors(names, names.where("id % 10 = 0").select("ticker", F.lit("ENERGY").alias("sector")))


@query("k17_sentiment_update", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'neutral' END AS sentiment_label, event_id % 2 = 0 AS processed FROM events")
def k17(spark, sf):
    rows = S.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.lit(None).cast("string").alias("sentiment_label"), F.lit(None).cast("double").alias("sentiment_score"), F.lit(False).alias("processed"))
    new = rows.where("id % 2 = 0").select("id", F.lit("neutral").alias("label"), F.lit(0.1).alias("negative"))
    return writers.with_sentiment(rows, new).drop("sentiment_score")


# ---- point in time, returns, backtests -------------------------------------

CUTOFF, START, END = "1996-06-30", "1995-01-01", "1998-01-01"


@query("j04_asof_cutoff", S.with_(S.LONG) + f"SELECT ticker, count(*) AS bars, max(date) AS last_date FROM bars WHERE date <= DATE '{CUTOFF}' GROUP BY ticker")
def j04(spark, sf):
    seen = pit.PointInTime(S.long_prices(spark, sf)).as_of(CUTOFF)
    return seen.groupBy("ticker").agg(F.count("*").alias("bars"), F.max("date").alias("last_date"))


@query("w10_lookback", S.with_(S.LONG) + f"SELECT ticker, date, close FROM bars WHERE date <= DATE '{CUTOFF}' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 20")
def w10(spark, sf):
    return pit.PointInTime(S.long_prices(spark, sf)).lookback(20, CUTOFF)


@query(
    "w13_expanding_stats",
    S.with_(S.LONG)
    + "SELECT ticker, date, count(close) OVER w AS close_n, round(avg(close) OVER w, 1) AS close_mean, round(stddev_pop(close) OVER w, 1) AS close_sd FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)",
)
def w13(spark, sf):
    out = pit.PointInTime(S.long_prices(spark, sf)).expanding("close")
    return out.select("ticker", "date", "close_n", F.round("close_mean", 1).alias("close_mean"), F.round("close_sd", 1).alias("close_sd"))


_PAIRS = """rets AS (SELECT ticker, date, ln(close) - ln(p) AS ret FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS p FROM bars) WHERE close > 0 AND p > 0)"""


@query("w02_log_returns", S.with_(S.LONG, _PAIRS) + "SELECT ticker, date, round(ret, 6) AS ret FROM rets")
def w02(spark, sf):
    return pit.log_returns(S.long_prices(spark, sf)).select("ticker", "date", *r6("ret"))


_MOMENTS = ["mean", "sd", "sharpe", "skewness", "kurtosis"]


@query(
    "a15_moments_sharpe",
    S.with_(
        S.LONG,
        _PAIRS,
        "m AS (SELECT ticker, avg(ret) AS mean, stddev_pop(ret) AS sd FROM rets GROUP BY ticker)",
        "s AS (SELECT r.ticker, count(*) AS n, any_value(mean) AS mean, any_value(sd) AS sd, any_value(mean / sd) AS sharpe, avg(((ret - mean) / sd) ** 3) AS skewness, avg(((ret - mean) / sd) ** 4) AS kurtosis FROM rets r JOIN m USING (ticker) GROUP BY r.ticker)",
    )
    + f"SELECT ticker, n, {r6_sql(*_MOMENTS)} FROM s",
)
def a15(spark, sf):
    return pit.moments(pit.log_returns(S.long_prices(spark, sf)), "ticker").select("ticker", "n", *r6(*_MOMENTS))


_BACKTEST = (
    S.LONG,
    """held AS (SELECT *, CASE WHEN close > lag(close, 20) OVER w THEN 1.0 ELSE 0.0 END AS position, lead(date) OVER w AS next_date, lead(close) OVER w AS next_close
        FROM bars WHERE date <= DATE '{1}' WINDOW w AS (PARTITION BY ticker ORDER BY date))""".replace("{1}", END),
    f"""days AS (SELECT ticker, next_date AS date, position, ln(next_close) - ln(close) AS raw_return, coalesce(lag(position) OVER (PARTITION BY ticker ORDER BY date), 0) AS before
        FROM held WHERE date >= DATE '{START}' AND next_date IS NOT NULL)""",
    "run AS (SELECT *, 0.0005 * abs(position - before) AS cost, raw_return * position - 0.0005 * abs(position - before) AS net_return FROM days)",
)


def momentum_days(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.backtest(S.long_prices(spark, sf), backtest.momentum(20), START, END)


@query("c16_backtest_momentum", S.with_(*_BACKTEST) + f"SELECT ticker, date, CAST(position AS DOUBLE) AS position, {r6_sql('raw_return')}, round(CAST(cost AS DOUBLE), 6) AS cost, round(net_return, 6) + 0.0 AS net_return FROM run")
def c16(spark, sf):
    return momentum_days(spark, sf).select("ticker", "date", "position", *r6("raw_return", "cost"), (F.round("net_return", 6) + F.lit(0.0)).alias("net_return"))


@query(
    "a24_backtest_totals",
    S.with_(*_BACKTEST) + "SELECT ticker, count(*) AS days, round(sum(net_return), 6) AS net_return, round(CAST(sum(cost) AS DOUBLE), 6) AS total_cost, count(*) FILTER (WHERE position <> before) AS n_position_changes FROM run GROUP BY ticker",
)
def a24(spark, sf):
    return backtest.totals(momentum_days(spark, sf), "ticker").select("ticker", "days", *r6("net_return", "total_cost"), "n_position_changes")


_TRIALS = (5, 10, 20, 40)


def phi_sql(z: str) -> str:
    """The normal distribution function, integrated."""
    return f"(0.5 + sign({z}) / sqrt(2 * pi()) * {_simpson(f'abs({z})', 'exp(-u * u / 2)')})"


def _moments_sql(source: str, keys: str) -> str:
    return f"""m AS (SELECT {keys}, avg(net_return) AS mean, stddev_pop(net_return) AS sd FROM {source} GROUP BY ALL),
        s AS (SELECT {keys}, count(*) AS n, mean, sd, mean / sd AS sharpe, avg(((net_return - mean) / sd) ** 3) AS skewness, avg(((net_return - mean) / sd) ** 4) AS kurtosis
              FROM {source} JOIN m USING ({keys}) GROUP BY {keys}, mean, sd)"""


def psr_sql(luck: str) -> str:
    return phi_sql(f"((sharpe - {luck}) * sqrt(n - 1) / sqrt(1 - skewness * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe))")


@query(
    "m08_psr",
    S.with_(
        *_BACKTEST,
        _moments_sql("run", "ticker"),
        "t AS (SELECT ticker, CAST(sum(cost) AS DOUBLE) AS total_cost, count(*) FILTER (WHERE position <> before) AS n_position_changes FROM run GROUP BY ticker)",
        f"found AS (SELECT s.*, total_cost, n_position_changes, sharpe * sqrt(252) AS annualised_sharpe, {psr_sql('0.0')} AS psr FROM s JOIN t USING (ticker))",
    )
    + f"SELECT ticker, n, n_position_changes, {r6_sql('sharpe', 'skewness', 'kurtosis', 'total_cost', 'annualised_sharpe', 'psr')} FROM found",
)
def m08(spark, sf):
    found = backtest.report(momentum_days(spark, sf), "ticker")
    return found.select("ticker", "n", "n_position_changes", *r6("sharpe", "skewness", "kurtosis", "total_cost", "annualised_sharpe", "psr"))


@query(
    "m10_dsr",
    S.with_(
        S.LONG,
        *[
            f"""held{k} AS (SELECT *, CASE WHEN close > lag(close, {k}) OVER w THEN 1.0 ELSE 0.0 END AS position, lead(date) OVER w AS next_date, lead(close) OVER w AS next_close
                FROM bars WHERE date <= DATE '{END}' WINDOW w AS (PARTITION BY ticker ORDER BY date)),
            days{k} AS (SELECT ticker, {k} AS lag, position, ln(next_close) - ln(close) AS raw, coalesce(lag(position) OVER (PARTITION BY ticker ORDER BY date), 0) AS before
                FROM held{k} WHERE date >= DATE '{START}' AND next_date IS NOT NULL)"""
            for k in _TRIALS
        ],
        "trials AS (" + " UNION ALL ".join(f"SELECT ticker, lag, raw * position - 0.0005 * abs(position - before) AS net_return FROM days{k}" for k in _TRIALS) + ")",
        _moments_sql("trials", "ticker, lag"),
        "v AS (SELECT ticker, count(*) AS n_trials, var_pop(sharpe) AS trial_variance FROM s GROUP BY ticker)",
        "best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY sharpe DESC, lag) = 1)",
        # what luck gives over four trials of variance 1, as a literal
        f"found AS (SELECT ticker, n_trials, trial_variance, lag AS best_lag, sharpe AS best_sharpe, {psr_sql('0.0')} AS psr, {psr_sql(f'sqrt(trial_variance) * {stats.expected_max_sharpe(len(_TRIALS), 1.0)!r}')} AS dsr FROM best JOIN v USING (ticker))",
    )
    + f"SELECT ticker, n_trials, best_lag, {r6_sql('trial_variance', 'best_sharpe', 'psr', 'dsr')} FROM found",
)
def m10(spark, sf):
    """Also M09 and A27."""
    bars = S.long_prices(spark, sf)
    days = None
    for n in _TRIALS:
        one = backtest.backtest(bars, backtest.momentum(n), START, END).withColumn("lag", F.lit(n))
        days = one if days is None else days.unionByName(one)
    return backtest.trials(days, "ticker", "lag").select("ticker", "n_trials", "best_lag", *r6("trial_variance", "best_sharpe", "psr", "dsr"))


def fixed_params(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters by rule from the variance, so that the filter needs no fit."""
    rows = pit.moments(pit.log_returns(S.long_prices(spark, sf)), "ticker")
    text = F.format_string(
        '{"omega": [%.12g, %.12g], "alpha": [0.05, 0.08], "beta": [0.85, 0.80], "stay": [0.9, 0.85]}', F.col("sd") * F.col("sd") * 0.05, F.col("sd") * F.col("sd") * 0.2
    )
    return rows.select("ticker", text.alias("params"))


@query("c11_regime_filter")
def c11(spark, sf):
    return regime.filter_all(S.long_prices(spark, sf), fixed_params(spark, sf)).select("ticker", "date", *r6("p_turbulent"))


@query("c18_threshold_trials")
def c18(spark, sf):
    return regime.run_trials(S.long_prices(spark, sf), fixed_params(spark, sf), START, END)


@query("c17_run_cycle")
def c17(spark, sf):
    return regime.run_cycle(S.long_prices(spark, sf), CUTOFF, END, most=40)


# ---- limits, text, models --------------------------------------------------


@query("st1_rate_limiter", admitted_sql("SELECT user_id AS key, ts, event_id AS id FROM events", 3, 24 * 3600))
def st1(spark, sf):
    rows = S.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
    return shown(limits.admit(rows, limit=3, window=24 * 3600.0))


@query("x04_html_text")
def x04(spark, sf):
    return S.table(spark, sf, "pages").select("page_id", X.html_text("html").alias("text"))


@query("c19_risk_sections")
def c19(spark, sf):
    return ingest.extract(S.table(spark, sf, "pages").select("page_id", "html"))


def _bare_sql(token: str) -> str:
    plain = f"""regexp_replace(regexp_replace(lower({token}), '^["''“‘(\\[]+', ''), '["''”’)\\],;:]+$', '')"""
    return f"(CASE WHEN NOT regexp_matches({plain}, '^-?[.,]?\\d[\\d.,-]*$') THEN {plain} WHEN {plain}[-1] = '.' THEN '#number.' ELSE '#number' END)"


_LOG = lambda k, n, p: f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + CASE WHEN {n} - {k} > 0 THEN ({n} - {k}) * ln(1 - {p}) ELSE 0 END)"


@query(
    "x07_abbreviation_scores",
    f"""WITH t AS (SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS t FROM documents),
        b AS (SELECT {_bare_sql('t')} AS b FROM t),
        w AS (SELECT CASE WHEN b[-1] = '.' AND NOT regexp_matches(b, '^[.]+$') THEN b[:-2] ELSE b END AS word, b[-1] = '.' AND NOT regexp_matches(b, '^[.]+$') AS p FROM b WHERE b <> ''),
        c AS (SELECT word, count(*) FILTER (WHERE p) AS k, count(*) AS n FROM w GROUP BY word HAVING count(*) FILTER (WHERE p) > 0),
        totals AS (SELECT count(*) AS tokens, count(*) FILTER (WHERE p) AS periods FROM w),
        s AS (SELECT *, periods / tokens AS r, length(word) - length(replace(word, '.', '')) AS inside, length(replace(word, '.', '')) AS letters FROM c, totals WHERE regexp_matches(word, '\\pL'))
        SELECT word, k AS with_period, n - k AS without_period,
               round(-2 * ({_LOG('k', 'n', 'r')} - {_LOG('k', 'n', '0.99::DOUBLE')}) * exp(-letters) * (inside + 1) * pow(letters, -(n - k)::DOUBLE), 6) AS score
        FROM s""".replace("\\\\", "\\"),
)
def x07_scores(spark, sf):
    """What the corpus says of words that come with a period."""
    pairs = sentences.pair_counts(S.table(spark, sf, "documents").select("text"), "text")
    scored = sentences.abbreviation_scores(sentences.word_counts(pairs))
    return scored.select("word", "with_period", "without_period", F.round("score", 6).alias("score"))


@query("x07_unsupervised_sentences")
def x07_unsupervised(spark, sf):
    """Sentences of the pages' and documents' own abbreviations; tests hold the tables and the cuts against cases written by hand."""
    docs = S.table(spark, sf, "documents").select("doc_id", "text")
    model = sentences.fit(docs, "text")
    found = sentences.with_sentences(storage.spread(docs), "text", model, most=2_000_000_000)
    rows = found.select("doc_id", F.explode("sentences").alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("s")).alias("chars"))


@query(
    "x07_sentences",
    """WITH s AS (SELECT doc_id, unnest(string_split_regex(replace(regexp_replace(text, '([.!?])[ \\t\\r\\n\\f\\v]+', '\\1\u0001', 'g'), '\u0001', chr(1)), chr(1))) AS s FROM documents)
       SELECT doc_id, count(*) AS n_sentences FROM (SELECT doc_id, trim(s, E' \\t\\r\\n\\f\\v') AS s FROM s) WHERE length(s) >= 20 GROUP BY doc_id""",
)
def x07(spark, sf):
    rows = S.table(spark, sf, "documents").select("doc_id", F.explode(expr.sentences(F.col("text"), most=2_000_000_000)).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_sentences"))


_STOP_SQL = ", ".join(f"'{w}'" for w in expr.STOP_WORDS)


@query(
    "x10_content_words",
    f"""SELECT item_id, CAST(len(w) AS INTEGER) AS n_words, array_to_string(list_sort(w), ' ') AS words FROM (
        SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 2 AND NOT list_contains([{_STOP_SQL}], x))) AS w FROM benchmark)""",
)
def x10(spark, sf):
    words = expr.content_words(F.col("text"))
    return S.table(spark, sf, "benchmark").select("item_id", F.size(words).alias("n_words"), F.array_join(F.array_sort(words), " ").alias("words"))


@query("x16_sha256", "SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def x16(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", expr.hashed(F.col("text")).alias("text_sha256"))


@query("x09_cited_ids", "SELECT event_id, [event_id % 5, event_id % 7, event_id % 5] AS ids FROM events")
def x09(spark, sf):
    text = F.format_string("One [id=%d, id=%d] and [id=%d].", F.col("event_id") % 5, F.col("event_id") % 7, F.col("event_id") % 5)
    return S.table(spark, sf, "events").select("event_id", expr.cited_ids(text).alias("ids"))


@query("f17_json_field", """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""")
def f17(spark, sf):
    return S.table(spark, sf, "events").select("event_id", expr.signal(F.col("props"), "k").alias("k"))


_WORD_LISTS = {name: ", ".join(f"'{w}'" for w in words) for name, words in (("p", X.POSITIVE), ("n", X.NEGATIVE))}


@query(
    "c10_document_scores",
    f"""WITH c AS (SELECT doc_id, string_split_regex(replace(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\r\\n\\f\\v]+', '\\1\u0001', 'g'), '\u0001', chr(1)), chr(1)) AS s FROM documents),
        t AS (SELECT doc_id, [x FOR x IN [trim(y, ' ') FOR y IN s] IF length(x) >= 20] AS s FROM c),
        e AS (SELECT doc_id, len(s) > 400 AS capped, unnest(s[:400]) AS x FROM t),
        w AS (SELECT doc_id, capped, regexp_extract_all(lower(x), '[a-z]+') AS w FROM e),
        k AS (SELECT doc_id, capped, len([x FOR x IN w IF x IN ({_WORD_LISTS["p"]})]) AS p, len([x FOR x IN w IF x IN ({_WORD_LISTS["n"]})]) AS n, len(w) / 20.0 AS l FROM w),
        g AS (SELECT doc_id, capped, p / (p + n + 1 + l) AS p, n / (p + n + 1 + l) AS n, 1 - (p + n) / (p + n + 1 + l) AS z FROM k),
        a AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n_sentences, avg(n) AS mean_negative, max(n) AS max_negative, avg(CASE WHEN n >= 0.5 THEN 1.0 ELSE 0.0 END) AS risk_density,
                     avg(z) AS mean_neutral, avg(p) AS mean_positive FROM g GROUP BY doc_id)
        SELECT doc_id, coalesce(n_sentences, 0) AS n_sentences, {r6_sql("mean_negative", "max_negative", "risk_density", "mean_neutral", "mean_positive")}
        FROM documents LEFT JOIN a USING (doc_id)""",
)
def c10(spark, sf):
    """Also A03: the cap of 400 sentences is the score's own."""
    found = X.score_documents(S.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return found.select("doc_id", "n_sentences", *r6("mean_negative", "max_negative", "risk_density", "mean_neutral", "mean_positive"))


@query("c08_explanation_gate")
def c08(spark, sf):
    """Assistants' whole texts as answers, plain and wrapped as JSON that cites one headline: the same text."""
    said = S.table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    heads = F.array(F.struct(F.col("turn").alias("id"), F.col("t").alias("text"), F.lit("chat").alias("source"), F.lit(0.5).alias("sentiment_score")))
    cited = F.to_json(F.struct(F.concat("t", F.format_string(" [id=%d].", F.col("turn"))).alias("narrative"), F.array("turn").alias("cited_ids")))
    raw = F.when(F.col("conv_id") % 3 == 0, F.col("t")).otherwise(cited)
    out = explain.verify(said.select("conv_id", "turn", raw.alias("raw"), heads.alias("headlines")))
    return out.select("conv_id", "turn", "status", "abstain_reason", "cited_ids")


@query("c09_explanations")
def c09(spark, sf):
    rows = alerts(spark, sf)
    names = S.companies(spark, sf).select(F.col("id").alias("company_id"), "ticker", F.col("name").alias("company_name"))
    found = evidence.headlines(rows, S.articles(spark, sf), S.links(spark, sf)).groupBy("alert_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("article_id").alias("id"), F.concat(F.lit("company news item "), "headline").alias("text"), "source", "sentiment_score"))).alias("headlines")
    )
    facts = rows.select(F.col("id").alias("alert_id"), "company_id", F.to_date("triggered_at").cast("string").alias("date"), F.col("explanation").alias("sigma_explanation"), "severity")
    facts = facts.join(names, "company_id").drop("company_id").join(found, "alert_id", "left")
    return explain.explain(facts)


_LOGITS = "embedding[1:3] AS a, [embedding[1] + 0.05 * embedding[4], embedding[2], embedding[3] - 0.05 * embedding[5]] AS b"


@query(
    "a26_model_agreement",
    f"""WITH l AS (SELECT vec_id, {_LOGITS} FROM embeddings),
        g AS (SELECT [abs(a[1] - b[1]), abs(a[2] - b[2]), abs(a[3] - b[3])] AS g, list_position(a, list_max(a)) <> list_position(b, list_max(b)) AS flip FROM l)
        SELECT count(*) AS n, round(CAST(max(list_max(g)) AS DOUBLE), 5) AS max_diff, round(sum(list_sum(g)) / (3.0 * count(*)), 5) AS mean_diff, count(*) FILTER (WHERE flip) AS flips FROM g""",
)
def a26(spark, sf):
    v = lambda i: F.element_at("embedding", i)
    rows = S.table(spark, sf, "embeddings").select(
        F.slice("embedding", 1, 3).alias("a"),
        F.array((v(1) + F.lit(0.05) * v(4)).cast("float"), v(2), (v(3) - F.lit(0.05) * v(5)).cast("float")).alias("b"),
    )
    out = modelops.agreement(rows, "a", "b")
    return out.select("n", F.round("max_diff", 5).alias("max_diff"), F.round("mean_diff", 5).alias("mean_diff"), "flips")


@query(
    "a25_argmax_label",
    """SELECT vec_id, CASE WHEN embedding[1] >= embedding[2] AND embedding[1] >= embedding[3] THEN 'positive' WHEN embedding[2] >= embedding[3] THEN 'negative' ELSE 'neutral' END AS label FROM embeddings""",
)
def a25(spark, sf):
    v = lambda i: F.element_at("embedding", i)
    return S.table(spark, sf, "embeddings").select("vec_id", expr.argmax_label(v(1), v(2), v(3)).alias("label"))


@query(
    "m05_softmax",
    """WITH e AS (SELECT vec_id, [exp(embedding[1]::DOUBLE), exp(embedding[2]::DOUBLE), exp(embedding[3]::DOUBLE)] AS e FROM embeddings)
       SELECT vec_id, round(e[1] / list_sum(e), 6) AS p1, round(e[2] / list_sum(e), 6) AS p2, round(e[3] / list_sum(e), 6) AS p3 FROM e""",
)
def m05(spark, sf):
    rows = S.table(spark, sf, "embeddings").select("vec_id", expr.softmax(F.slice("embedding", 1, 3)).alias("p"))
    return rows.select("vec_id", *[F.round(F.col("p")[k], 6).alias(f"p{k + 1}") for k in range(3)])


@query("s16_bar_counts", S.with_(S.LONG) + "SELECT ticker, count(*) AS bars FROM bars GROUP BY ticker")
def s16(spark, sf):
    return readers.bar_counts(S.long_prices(spark, sf))


@query("s09_latest_filings", S.with_(S.FILINGS) + "SELECT company AS cik, filing_id AS accession_number, filed_date FROM filings QUALIFY row_number() OVER (PARTITION BY company ORDER BY filed_date DESC, filing_id DESC) <= 3")
def s09(spark, sf):
    rows = S.filings(spark, sf).select(F.col("company").alias("cik"), F.col("filing_id").alias("accession_number"), "filed_date")
    return ingest.latest_filings(rows.where("accession_number % 2 = 0"), rows.where("accession_number % 2 <> 0"))


@query("u04_first_tickers", "SELECT DISTINCT c_name AS ticker FROM customer ORDER BY 1 LIMIT 25")
def u04(spark, sf):
    return anomaly.first_tickers(S.companies(spark, sf), 25)


@query("a02_first_company", "SELECT c_mktsegment AS ticker, min(c_custkey) AS company_id FROM customer GROUP BY 1")
def a02(spark, sf):
    return anomaly.first_company(S.companies(spark, sf).select(F.col("sector").alias("ticker"), F.col("id").alias("company_id")))


@query("s17_point_lookup", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_name = (SELECT max(c_name) FROM customer)")
def s17(spark, sf):
    names = S.companies(spark, sf)
    last = names.agg(F.max("ticker")).first()[0]
    return names.where(F.col("ticker") == last).select("id", "name")


@query("j15_ticker_to_cik", "SELECT upper(c_name) AS ticker, CASE WHEN c_custkey % 4 <> 0 THEN lpad(c_custkey::VARCHAR, 10, '0') END AS cik, CASE WHEN c_custkey % 4 = 0 THEN 'not_found' ELSE 'found' END AS status FROM customer")
def j15(spark, sf):
    names = S.companies(spark, sf)
    ciks = names.where("id % 4 <> 0").select(F.upper("ticker").alias("ticker"), readers.padded_cik(F.col("id").cast("string")).alias("cik"))
    return ingest.resolve(names, ciks)


@query(
    "f08_min_history",
    S.with_(*S.BASE) + "SELECT ticker, count(*) AS days FROM features GROUP BY ticker HAVING count(*) >= 8",
)
def f08(spark, sf):
    days = Window.partitionBy("ticker")
    rows = features(spark, sf).withColumn("days", F.count("*").over(days)).where(F.col("days") >= panel.MIN_DAYS)
    return rows.select("ticker", "days").distinct()


@query("m06_normal_cdf", f"SELECT vec_id, round(x, 6) AS x, round({phi_sql('x')}, 9) AS p, round(x, 6) AS back FROM (SELECT vec_id, embedding[1]::DOUBLE AS x FROM embeddings)")
def m06(spark, sf):
    """The distribution function and its inverse over scores."""
    c = stats.columns()
    rows = S.table(spark, sf, "embeddings").select("vec_id", F.element_at("embedding", 1).cast("double").alias("x"))
    rows = rows.withColumn("p", c["normal_cdf"]("x")).withColumn("back", F.round(c["inverse_normal_cdf"]("p"), 6))
    return rows.select("vec_id", *r6("x"), *r9("p"), "back")


