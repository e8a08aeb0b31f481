"""The domain's tables made from general ones, in DataFrames and in SQL.

companies from customer, news and daily prices from events (weekdays alone have
prices, so weekend news must roll), a long price series from orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("ticker"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector")
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("event_type") == "error", "negative").when(F.col("event_type") == "purchase", "positive").otherwise("neutral")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), "event_id").alias("url"),
        F.col("event_type").alias("headline"),
        F.lit("feed").alias("source"),
        F.col("ts").cast("timestamp").alias("published_at"),
        label.alias("sentiment_label"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("sentiment_score"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("article_id"), F.col("user_id").alias("company_id"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators import panel

    return panel.load_news(articles(spark, sf_dir), links(spark, sf_dir), companies(spark, sf_dir))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (company_id, ticker, day, open, high, low, close, volume) of weekdays."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("company_id"), F.to_date("ts").alias("day"), "ts", "event_id", "value")
    order = F.struct("ts", "event_id")
    bars = (
        rows.where(F.weekday("day") < 5)
        .groupBy("company_id", "day")
        .agg(
            F.min_by("value", order).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", order).alias("close"),
            F.count("*").alias("volume"),
        )
    )
    names = companies(spark, sf_dir).select(F.col("id").alias("company_id"), "ticker")
    return bars.join(names, "company_id")


def long_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price series (ticker, date, close) for each market segment."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), "o_totalprice")
    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("ticker"))
    return orders.join(segments, "o_custkey").groupBy("ticker", "date").agg(F.round(F.avg("o_totalprice"), 6).alias("close"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(filing_id, ticker, filed_date, company) and numbers in place of text features."""
    orders = table(spark, sf_dir, "orders")
    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("ticker"), F.col("c_name").alias("company"))
    key = F.col("o_orderkey")
    return orders.join(segments, "o_custkey").select(
        key.alias("filing_id"),
        "ticker",
        "company",
        F.to_date("o_orderdate").alias("filed_date"),
        ((key * 7919 % 1009) / 1009).alias("mean_negative"),
        ((key * 104729 % 997) / 997).alias("risk_density"),
        (key * 31 % 160).cast("int").alias("n_sentences"),
        (F.col("o_totalprice") / 1000).alias("max_negative"),
    )


# ---- the same for DuckDB ---------------------------------------------------

COMPANIES = "companies AS (SELECT c_custkey AS id, c_name AS ticker, c_name AS name, c_mktsegment AS sector FROM customer)"
NEWS = """news AS (
    SELECT event_id AS article_id, user_id AS company_id, c_name AS ticker, ts AS published_at, CAST(ts AS DATE) AS pub_day,
           least(value / 500, 1.0) AS neg, event_type AS headline,
           CASE event_type WHEN 'error' THEN 'negative' WHEN 'purchase' THEN 'positive' ELSE 'neutral' END AS label
    FROM events JOIN customer ON c_custkey = user_id)"""
PRICES = """prices AS (
    SELECT user_id AS company_id, c_name AS ticker, CAST(ts AS DATE) AS day, first(value ORDER BY ts, event_id) AS open,
           max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume
    FROM events JOIN customer ON c_custkey = user_id WHERE isodow(ts) <= 5 GROUP BY ALL)"""
LONG = """bars AS (
    SELECT c_mktsegment AS ticker, CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice), 6) AS close
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""
FILINGS = """filings AS (
    SELECT o_orderkey AS filing_id, c_mktsegment AS ticker, c_name AS company, CAST(o_orderdate AS DATE) AS filed_date,
           (o_orderkey * 7919 % 1009) / 1009.0::DOUBLE AS mean_negative, (o_orderkey * 104729 % 997) / 997.0::DOUBLE AS risk_density,
           CAST(o_orderkey * 31 % 160 AS INTEGER) AS n_sentences, o_totalprice / 1000 AS max_negative
    FROM orders JOIN customer ON c_custkey = o_custkey)"""
ROLLED = """rolled AS (
    SELECT n.ticker, n.neg, n.label, p.day FROM news n ASOF JOIN (SELECT ticker, day FROM prices) p ON n.ticker = p.ticker AND n.pub_day <= p.day)"""
DAILY = """daily AS (
    SELECT ticker, day, count(*) AS news_n, avg(neg) AS news_neg, avg(CASE WHEN label = 'negative' THEN 1.0 ELSE 0.0 END) AS neg_ratio
    FROM rolled GROUP BY ALL)"""
RETURNS = """rets AS (
    SELECT ticker, day, ln(close / lag(close) OVER w) AS ret, count(*) OVER (PARTITION BY ticker) AS n_prices
    FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY day))"""
FEATURES = """features AS (
    SELECT d.ticker, d.day, news_n, news_neg, neg_ratio, abs(ret) AS abs_ret FROM daily d JOIN rets r ON d.ticker = r.ticker AND d.day = r.day
    WHERE ret IS NOT NULL AND n_prices >= 3)"""
PANEL = """panel AS (
    SELECT d.ticker, d.day, abs(ret) AS abs_ret, fwd_vol, news_n, news_neg, neg_ratio
    FROM daily d JOIN (
        SELECT *, CASE WHEN count(ret) OVER f = 5 THEN stddev_samp(ret) OVER f * sqrt(252) END AS fwd_vol FROM rets
        WINDOW f AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) r
    ON d.ticker = r.ticker AND d.day = r.day WHERE n_prices >= 7)"""


def z(column: str, over: str = "PARTITION BY ticker") -> str:
    return f"CASE WHEN stddev_pop({column}) OVER ({over}) > 0 THEN ({column} - avg({column}) OVER ({over})) / stddev_pop({column}) OVER ({over}) ELSE {column} * 0.0 END"


SCORED = f"""scored AS (
    SELECT *, greatest(abs(z_news_n), abs(z_news_neg), abs(z_neg_ratio), abs(z_abs_ret)) AS max_abs_z FROM (
        SELECT *, {z("news_n")} AS z_news_n, {z("news_neg")} AS z_news_neg, {z("neg_ratio")} AS z_neg_ratio, {z("abs_ret")} AS z_abs_ret
        FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS n_days FROM features) WHERE n_days >= 8))"""
ALERTS = """alerts AS (
    SELECT c.id * 100 + day(s.day) AS alert_id, c.id AS company_id, s.ticker, s.day, max_abs_z,
           CASE WHEN max_abs_z >= 4 THEN 'high' WHEN max_abs_z >= 3 THEN 'medium' ELSE 'low' END AS severity
    FROM scored s JOIN companies c ON c.ticker = s.ticker WHERE max_abs_z >= 1.8)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE = (NEWS, PRICES, ROLLED, DAILY, RETURNS, FEATURES)
