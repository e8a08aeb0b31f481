"""From what a network gave to rows that can be stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.functions import text as X
from tidemark.operators.anomaly import ranked


def normalise_articles(raw: DataFrame) -> DataFrame:
    """(url, headline, body, source, published_at); what has no url or headline goes."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = raw.select(
        *[c for c in ("ticker", "seq") if c in raw.columns],
        text("url").alias("url"),
        text("headline").alias("headline"),
        F.nullif(text("summary"), F.lit("")).alias("body"),
        F.coalesce(F.nullif(text("source"), F.lit("")), F.lit("unknown")).alias("source"),
        expr.from_epoch(F.col("datetime")).alias("published_at"),
    )
    return rows.where("url <> '' and headline <> ''")


def first_of_feed(feed: DataFrame, order: str = "seq") -> DataFrame:
    """One article for each url, the first."""
    rank = F.row_number().over(Window.partitionBy("url").orderBy(order))
    return feed.withColumn("_r", rank).where("_r = 1").drop("_r")


def latest_filings(recent: DataFrame, archived: DataFrame | None = None, n: int = 3) -> DataFrame:
    """Each company's newest filings, from both lists."""
    rows = recent if archived is None else recent.unionByName(archived)
    rows = rows.dropDuplicates(["cik", "accession_number"])
    return ranked(rows, ["cik"], n, F.desc("filed_date"), F.desc("accession_number")).drop("rank")


def resolve(tickers: DataFrame, ciks: DataFrame) -> DataFrame:
    """Tickers with their cik, or the status ``not_found``."""
    out = tickers.select(F.upper("ticker").alias("ticker")).join(ciks, "ticker", "left")
    return out.withColumn("status", F.when(F.col("cik").isNull(), "not_found").otherwise("found"))


def extract(filings: DataFrame) -> DataFrame:
    """C19 over filings with ``html``: status, section, length and flags."""
    out = filings.withColumn("_e", X.item_1a("html")).drop("html")
    return out.withColumns({"status": F.col("_e.status"), "section": F.col("_e.text"), "length": F.col("_e.length"), "flags": F.col("_e.flags")}).drop("_e")


def ingest(tickers: DataFrame, ciks: DataFrame, filings: DataFrame, n: int = 3) -> DataFrame:
    """A status row for each ticker and filing: not_found, no_filings, or that of the extraction."""
    found = resolve(tickers, ciks)
    done = extract(latest_filings(filings, None, n)).withColumnRenamed("status", "_status")
    rows = found.join(done, "cik", "left")
    status = F.when(F.col("status") == "not_found", F.col("status")).when(F.col("_status").isNull(), "no_filings").otherwise(F.col("_status"))
    return rows.withColumn("status", status).drop("_status")


def ticker_summaries(tickers: DataFrame, ciks: DataFrame, filings: DataFrame, n: int = 3) -> DataFrame:
    """A row for each ticker asked for: not_found, no_10k or ok, how many filings were stored, and their quality.

    ``filings`` (cik, accession_number, filed_date, html) have a null html where
    none could be fetched; these aren't stored and say ``fetch_failed``. Tickers
    that are asked for twice are one row.
    """
    found = resolve(tickers.select(F.upper("ticker").alias("ticker")).distinct(), ciks)
    newest = latest_filings(filings, None, n).withColumn("_gone", F.col("html").isNull())
    done = extract(newest).withColumn("status", F.when(F.col("_gone"), "fetch_failed").otherwise(F.col("status")))
    one = F.struct(F.col("accession_number").alias("accession"), F.col("filed_date").alias("filed"), "status", "length", "flags")
    each = done.groupBy("cik").agg(F.count(F.when(~F.col("_gone"), 1)).alias("_stored"), F.array_sort(F.collect_list(one)).alias("quality"))
    rows = found.join(each, "cik", "left")
    status = F.when(F.col("status") == "not_found", F.col("status")).when(F.col("quality").isNull(), "no_10k").otherwise("ok")
    return rows.select("ticker", status.alias("status"), F.coalesce("_stored", F.lit(0)).alias("filings_stored"), "quality")


def quality_report(results: DataFrame) -> DataFrame:
    """Totals by status, how many have flags, and the share that can be used."""
    is_status = lambda s: F.count(F.when(F.col("status") == s, 1))
    out = results.agg(
        F.count("*").alias("total"),
        is_status("extracted").alias("extracted"),
        is_status("incorporated_by_reference").alias("incorporated_by_reference"),
        is_status("not_found").alias("not_found"),
        F.count(F.when((F.col("status") == "extracted") & (F.size("flags") > 0), 1)).alias("flagged"),
    )
    return out.withColumn("usable_rate", F.coalesce(F.try_divide(F.col("extracted") - F.col("flagged"), F.col("total")), F.lit(0.0)))


def store_news(feed: DataFrame, companies: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Articles (first values, last headline) and links (url, company_id) of a feed with tickers."""
    rows = normalise_articles(feed)
    articles = rows.groupBy("url").agg(
        F.max_by("headline", order).alias("headline"), F.min_by("body", order).alias("body"), F.min_by("source", order).alias("source"), F.min_by("published_at", order).alias("published_at")
    )
    names = companies.select(F.col("id").alias("company_id"), "ticker")
    return articles, rows.select("url", "ticker").distinct().join(names, "ticker").select("url", "company_id")
