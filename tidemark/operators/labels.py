"""Realized volatility after filings, and labels by terciles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.operators.quantiles import quantiles
from tidemark.sources.storage import checkpoint

WINDOW_DAYS, MIN_RETURNS = 30, 10
#: Days of a bin of the range join.
BIN = 32


def realized_vol(filings: DataFrame, prices: DataFrame, window: int = WINDOW_DAYS, least: int = MIN_RETURNS, key: str = "ticker") -> DataFrame:
    """(filing_id, realized_vol, window_start, window_end, n_returns) for filings (filing_id, key, filed_date).

    Prices count in (filed, filed + window]; those that are null or not positive
    go before returns are made. Filings without enough prices stay with nulls.
    The range join is an equi-join on key and bin of days: a filing's window
    touches ``window // BIN + 2`` bins at most, so a company's bars are met by
    few filings, not by all of them. Filings of one key and day share a window,
    which is worked out once.
    """
    end = F.date_add("filed_date", window)
    days = lambda c: F.floor(F.unix_date(c) / BIN)
    spans = filings.select(key, "filed_date").distinct().withColumn(
        "_bin", F.explode(F.sequence(days(F.date_add("filed_date", 1)), days(end)))
    )
    bars = prices.where("close > 0").select(key, "day", "close", days(F.col("day")).alias("_bin"))
    inside = spans.join(bars, [key, "_bin"]).where((F.col("day") > F.col("filed_date")) & (F.col("day") <= end))
    order = Window.partitionBy(key, "filed_date").orderBy("day")
    moved = inside.withColumn("r", F.ln(F.col("close")) - F.lag(F.ln(F.col("close"))).over(order))
    found = moved.groupBy(key, "filed_date").agg(
        F.stddev_samp("r").alias("_sd"), F.count("r").cast("int").alias("_n"), F.min("day").alias("_first")
    )
    enough = F.col("_n") >= least
    return filings.select("filing_id", key, "filed_date", end.alias("window_end")).join(found, [key, "filed_date"], "left").select(
        "filing_id",
        F.when(enough, expr.annualised(F.col("_sd"))).alias("realized_vol"),
        F.when(enough, F.col("_first")).alias("window_start"),
        "window_end",
        F.coalesce("_n", F.lit(0)).alias("n_returns"),
    )


def terciles(vols: DataFrame, column: str = "realized_vol") -> DataFrame:
    """One row (tercile_low, tercile_high), exact with linear interpolation."""
    return quantiles(vols, column, [1 / 3, 2 / 3]).select(F.col("q")[0].alias("tercile_low"), F.col("q")[1].alias("tercile_high"))


def label_filings(filings: DataFrame, prices: DataFrame, key: str = "ticker", source: str = "adjusted_close") -> DataFrame:
    """Volatility, terciles and label of every filing; filings without volatility have a null label."""
    vols = checkpoint(realized_vol(filings, prices, key=key))
    cuts = terciles(vols)
    return (
        vols.join(F.broadcast(cuts))
        .withColumn("vol_label", expr.tercile(F.col("realized_vol"), F.col("tercile_low"), F.col("tercile_high")))
        .withColumn("price_source", F.lit(source))
    )


def label_counts(labels: DataFrame) -> DataFrame:
    """Labels counted, null as ``null``."""
    return labels.groupBy(F.coalesce("vol_label", F.lit("null")).alias("vol_label")).agg(F.count("*").alias("n"))
