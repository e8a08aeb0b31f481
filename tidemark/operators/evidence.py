"""Alerts with their evidence: set-based plans for what is asked one alert at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.operators.anomaly import ranked
from tidemark.sources.storage import checkpoint


def same_day(published: Column, triggered: Column) -> Column:
    """calendar days of the session, neither rolled nor local."""
    return F.to_date(published) == F.to_date(triggered)


def headlines(alerts: DataFrame, news: DataFrame, links: DataFrame, limit: int = 5) -> DataFrame:
    """Each alert's most negative headlines of its company and day.

    (alert_id, rank, article_id, headline, source, sentiment_score); scores that
    are null come last, ties by article. Alerts are few: only links of their
    companies meet news, and only news of their days. The day is part of the
    join key, so a company with many articles is met by day.
    """
    wanted = checkpoint(alerts.select(F.col("id").alias("alert_id"), "company_id", F.to_date("triggered_at").alias("day")))
    dated = news.select(F.col("id").alias("article_id"), "headline", "source", "sentiment_score", F.to_date("published_at").alias("day"))
    dated = dated.join(wanted.select("day").distinct(), "day", "left_semi")
    linked = links.select("article_id", "company_id").join(wanted.select("company_id").distinct(), "company_id", "left_semi").join(dated, "article_id")
    rows = wanted.join(linked, ["company_id", "day"])
    best = ranked(rows, ["alert_id"], limit, F.desc_nulls_last("sentiment_score"), "article_id")
    return best.select("alert_id", "rank", "article_id", "headline", "source", "sentiment_score")


def severity_rank(severity: Column) -> Column:
    """T01."""
    return F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "low", 2).otherwise(3)


def alert_feed(alerts: DataFrame, companies: DataFrame, severity: str | None = None, ticker: str | None = None, limit: int | None = None) -> DataFrame:
    """C20 (J07, F03, F04, T01): the worst and newest alerts. Filters that aren't asked for aren't in the plan."""
    names = companies.select(F.col("id").alias("company_id"), "ticker", "name")
    rows = alerts.select(F.col("id").alias("alert_id"), "company_id", "triggered_at", "alert_type", "severity", "explanation", "resolved")
    if level := expr.optional(severity):
        rows = rows.where(F.col("severity") == level)
    if code := expr.optional(ticker, upper=True):
        names = names.where(F.upper("ticker") == code)
    out = rows.join(names, "company_id").orderBy(severity_rank(F.col("severity")), F.desc("triggered_at"), "alert_id")
    return out.limit(expr.limit_of(limit))


def risk_detail(
    companies: DataFrame, alerts: DataFrame, news: DataFrame, links: DataFrame, explanations: DataFrame, ticker: str, limit: int = 5
) -> DataFrame:
    """C21 (S17, T02, J08, J09, R08): one row for a company, with its alerts, their headlines and explanations nested; none for an unknown ticker.

    An alert stored twice is listed twice; of several explanations of an alert the greatest by status, narrative and citations holds.
    """
    company = companies.where(F.upper("ticker") == ticker.upper()).select(F.col("id").alias("company_id"), "ticker", "name")
    own = alerts.join(F.broadcast(company), "company_id", "left_semi")
    found = headlines(own, news, links, limit).groupBy("alert_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "article_id", "headline", "source", "sentiment_score"))).alias("headlines")
    )
    told = explanations.groupBy("alert_id").agg(F.max(F.struct("status", "narrative", "cited_ids")).alias("explanation"))
    rows = own.select(F.col("id").alias("alert_id"), "company_id", "triggered_at", "alert_type", "severity", F.col("explanation").alias("note"))
    rows = rows.join(found, "alert_id", "left").join(told, "alert_id", "left")
    entry = F.struct((-F.unix_micros(F.col("triggered_at"))).alias("newest"), "alert_id", "triggered_at", "alert_type", "severity", "note", "headlines", "explanation")
    nested = rows.groupBy("company_id").agg(F.array_sort(F.collect_list(entry)).alias("alerts"))
    return company.join(nested, "company_id", "left")


def alert_news(news: DataFrame, links: DataFrame, alerts: DataFrame) -> DataFrame:
    """Articles with an alert of their company on their day, without their bodies."""
    days = alerts.select("company_id", F.to_date("triggered_at").alias("day")).distinct()
    hit = (
        links.select("article_id", "company_id")
        .join(news.select(F.col("id").alias("article_id"), F.to_date("published_at").alias("day")), "article_id")
        .join(days, ["company_id", "day"], "left_semi")
        .select(F.col("article_id").alias("id"))
        .distinct()
    )
    return news.join(hit, "id", "left_semi").withColumn("body", F.lit(None).cast("string"))


def demo_extract(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables a demonstration needs, in the order of their references."""
    news = alert_news(tables["news_articles"], tables["article_companies"], tables["alerts"])
    links = tables["article_companies"].join(news.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    return {
        "companies": tables["companies"],
        "news_articles": news,
        "article_companies": links.select(*tables["article_companies"].columns),
        "alerts": tables["alerts"],
        "alert_explanations": tables["alert_explanations"],
    }


def unscored(filings: DataFrame, scores: DataFrame, version: str) -> DataFrame:
    """Filings without a score of a model version."""
    done = scores.where(F.col("model_version") == version).select(F.col("filing_id").alias("id"))
    return filings.join(done, "id", "left_anti")


def unexplained(alerts: DataFrame, explanations: DataFrame, redo: bool = False) -> DataFrame:
    """F13."""
    return alerts if redo else alerts.join(explanations.select(F.col("alert_id").alias("id")), "id", "left_anti")
