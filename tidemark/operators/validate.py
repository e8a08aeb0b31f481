"""Does a filing's risk language track volatility? Level, change, sectors: tidy tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr, stats
from tidemark.operators import rankings, ranks
from tidemark.operators.quantiles import quantiles
from tidemark.sources.storage import checkpoint

FEATURES = ["mean_negative", "max_negative", "risk_density", "mean_neutral", "mean_positive"]
CHANGES = ["d_mean_negative", "d_risk_density", "d_n_sentences"]
LOW_SENTENCES = 50


def load_dataset(scores: DataFrame, filings: DataFrame, labels: DataFrame, companies: DataFrame, version: str) -> DataFrame:
    """Filings with a label and a score of one model version."""
    s = F.col("signal_breakdown")
    wide = scores.where(F.col("model_version") == version).select("filing_id", *[s[c].alias(c) for c in ("n_sentences", *FEATURES)])
    known = labels.where("realized_vol is not null").select("filing_id", "realized_vol", "vol_label")
    rows = wide.join(known, "filing_id").join(filings.select(F.col("id").alias("filing_id"), "company_id", "filed_date"), "filing_id")
    names = companies.select(F.col("id").alias("company_id"), "ticker", F.coalesce("sector", F.lit("Unknown")).alias("sector"))
    return rows.join(names, "company_id")


def confident(rows: DataFrame, least: int = LOW_SENTENCES) -> DataFrame:
    """F07."""
    return rows.where(F.coalesce("n_sentences", F.lit(0)) >= least)


def sector_view(rows: DataFrame) -> DataFrame:
    """A04."""
    return rows.groupBy("sector").agg(
        F.count("*").alias("n"), F.avg("mean_negative").alias("mean_neg"), F.avg("realized_vol").alias("mean_vol")
    ).orderBy(F.desc("mean_neg"), "sector")


def company_averages(rows: DataFrame, features: list[str] | None = None) -> DataFrame:
    """A row for each company; the sector is its smallest name."""
    return rows.groupBy("ticker").agg(
        F.min("sector").alias("sector"), F.avg("realized_vol").alias("realized_vol"), *[F.avg(f).alias(f) for f in features or FEATURES]
    )


def bucket_means(rows: DataFrame, features: list[str] | None = None) -> DataFrame:
    """For each feature its mean by label (null for a missing one) and ``UP`` or ``DOWN`` from low to high."""
    buckets = ["low", "medium", "high"]
    names = features or FEATURES
    long = rows.select("vol_label", F.explode(F.create_map(*[x for f in names for x in (F.lit(f), F.col(f).cast("double"))])).alias("feature", "value"))
    wide = long.groupBy("feature").pivot("vol_label", buckets).agg(F.avg("value"))
    return wide.withColumn("trend", F.when(F.col("high") > F.col("low"), "UP").otherwise("DOWN"))


def correlations(blocks: DataFrame, features: list[str] | None = None) -> DataFrame:
    """For each ``block`` and feature (rho, p, n, h, h_p, low, medium, high, trend), all from one ranking."""
    names = features or FEATURES
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in names])
    long = checkpoint(blocks.select("block", "vol_label", F.col("realized_vol").alias("y"), F.explode(each).alias("f")).select("block", "f.feature", "f.x", "y", "vol_label"))
    groups = ["block", "feature"]
    rho, sums = rankings.study(groups, long.select(*groups, "x", "y"), long.select(*groups, "x", F.col("vol_label").alias("label")))
    h = rankings.kruskal_of(sums, groups).withColumn("h_p", stats.columns()["chi2_tail"]("h", F.col("labels") - 1)).select(*groups, "h", "h_p")
    means = long.groupBy(*groups).agg(*[F.avg(F.when(F.col("vol_label") == b, F.col("x"))).alias(b) for b in ("low", "medium", "high")])
    means = means.withColumn("trend", F.when(F.col("high") > F.col("low"), "UP").otherwise("DOWN"))
    return means.join(ranks.with_p(rho), groups, "left").join(h, groups, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def analyze(rows: DataFrame) -> DataFrame:
    """All filings, confident ones, without financials, company averages (mean_negative alone), and sectors.

    A sector's row has its name as ``feature``, and the means of ``mean_negative`` and volatility.
    """
    rows = checkpoint(rows.select("ticker", "sector", "n_sentences", "vol_label", F.col("realized_vol").cast("double").alias("realized_vol"), *FEATURES))
    average = company_averages(rows).select(F.lit("company_average").alias("block"), "mean_negative", "realized_vol")
    held = [rows, confident(rows), rows.where(~expr.is_financial(F.col("sector")))]
    columns = ["vol_label", "realized_vol", *FEATURES]
    blocks = [b.select(F.lit(name).alias("block"), *columns) for b, name in zip(held, ("all", "confident", "ex_financials"))]
    # company averages are one more block with one feature
    found = correlations(reduce(DataFrame.unionByName, [*blocks, average.select("block", F.lit(None).cast("string").alias("vol_label"), "realized_vol", "mean_negative", *[F.lit(None).cast("double").alias(f) for f in FEATURES if f != "mean_negative"])]))
    last = F.col("block") == "company_average"
    found = found.where(~last | (F.col("feature") == "mean_negative")).withColumn("trend", F.when(~last, F.col("trend")))
    sector = sector_view(rows).select(F.lit("sector").alias("block"), F.col("sector").alias("feature"), "n", "mean_neg", "mean_vol")
    return found.select("block", "feature", "rho", "p", "n", "h", "h_p", "low", "medium", "high", "trend").unionByName(sector, allowMissingColumns=True)


def build_changes(rows: DataFrame) -> DataFrame:
    """Differences to the company's filing before, and the days in between; first filings go."""
    order = Window.partitionBy("ticker").orderBy("filed_date", "filing_id")
    moved = {f"d_{c}": F.col(c) - F.lag(c).over(order) for c in ("mean_negative", "risk_density", "n_sentences", "realized_vol")}
    out = rows.withColumns(moved | {"gap_days": F.datediff("filed_date", F.lag("filed_date").over(order))})
    return out.dropna(subset=["d_mean_negative", "d_realized_vol"])


def change_summary(changes: DataFrame) -> DataFrame:
    """Observations, companies, median gap and pairs off the yearly cycle."""
    changes = checkpoint(changes.select("ticker", "gap_days"))
    counts = changes.agg(
        F.count("*").alias("n"),
        F.countDistinct("ticker").alias("companies"),
        F.count(F.when((F.col("gap_days") < 200) | (F.col("gap_days") > 500), 1)).alias("off_cycle"),
    )
    median = quantiles(changes, "gap_days", [0.5]).select(F.col("q")[0].alias("median_gap"))
    return counts.join(F.broadcast(median)).select("n", "companies", "median_gap", "off_cycle")


def rose_fell(changes: DataFrame) -> DataFrame:
    """For each direction that occurs, its number and the medians of volatility and of its change."""
    direction = F.when(F.col("d_mean_negative") > 0, "rose").otherwise("fell").alias("direction")
    changes = checkpoint(changes.select(direction, "realized_vol", "d_realized_vol"))
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in ("realized_vol", "d_realized_vol")])
    long = changes.select("direction", F.explode(each).alias("v")).select("direction", "v.column", "v.value")
    medians = rankings.quantiles_by(long, ["direction", "column"], [0.5]).groupBy("direction").agg(
        *[F.max(F.when(F.col("column") == c, F.col("q")[0])).alias(m) for c, m in (("realized_vol", "median_vol"), ("d_realized_vol", "median_d_vol"))]
    )
    return changes.groupBy("direction").agg(F.count("*").alias("n")).join(medians, "direction", "left")


def analyze_change(changes: DataFrame) -> DataFrame:
    """Rank correlations of changes with level and change of volatility, and Mann-Whitney tests: (test, x, y, statistic, p, n)."""
    ys = ("realized_vol", "d_realized_vol")
    changes = checkpoint(changes.select(*CHANGES, *ys))
    cell = lambda x, y: F.struct(F.lit(x).alias("name"), F.lit(y).alias("against"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    pairs = changes.select(F.explode(F.array(*[cell(f, y) for f in CHANGES for y in ys])).alias("c")).select("c.*")
    direction = F.when(F.col("d_mean_negative") > 0, "rose").otherwise("fell").alias("label")
    splits = changes.select(direction, F.explode(F.array(*[F.struct(F.lit("rose").alias("name"), F.lit(y).alias("against"), F.col(y).cast("double").alias("x")) for y in ys])).alias("c"))
    groups = ["name", "against"]
    rho, sums = rankings.study(groups, pairs, splits.select("c.*", "label"))
    of_pairs = ranks.with_p(rho).select(F.lit("spearman").alias("test"), F.col("name").alias("x"), F.col("against").alias("y"), F.col("rho").alias("statistic"), "p", "n")
    p = stats.columns()["mann_whitney_p"]
    u = rankings.mann_whitney_of(sums, groups, "rose")
    of_splits = u.select(
        F.lit("mann_whitney").alias("test"), F.col("name").alias("x"), F.col("against").alias("y"), F.col("u").alias("statistic"),
        p("u", "n1", "n2", "ties").alias("p"), (F.col("n1") + F.col("n2")).alias("n"),
    )
    return of_pairs.unionByName(of_splits)
