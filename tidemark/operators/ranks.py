"""Rank statistics. Ranks are windows and sums are aggregates; only p-values are Python.

A rank over a whole column can't be a window without partitions (all rows would
meet in one task). ``global_rank`` takes the sums of ``quantiles.cumulated``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import panel as P
from tidemark.operators import rankings
from tidemark.operators.quantiles import cumulated, quantiles
from tidemark.sources.storage import checkpoint


def average_rank(column: str, *keys: str) -> Column:
    """Ranks within keys, ties averaged."""
    order = Window.partitionBy(*keys).orderBy(column)
    ties = Window.partitionBy(*keys, column)
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2


def global_rank(rows: DataFrame, column: str, name: str, ranges: int = 64) -> DataFrame:
    """W05 over all rows: ``rows`` with the average rank of ``column`` (and ``name_ties``, how many share it)."""
    ranked = cumulated(rows, column, ranges).select("_v", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name), F.col("_n").alias(f"{name}_ties"))
    return rows.join(ranked, rows[column] == ranked["_v"]).drop("_v")


def _rho(x: str, y: str) -> Column:
    """Correlation, null without variance (where ``corr`` would divide by zero)."""
    varied = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    top = F.avg(F.col(x) * F.col(y)) - F.avg(x) * F.avg(y)
    return F.when(varied, F.try_divide(top, F.stddev_pop(x) * F.stddev_pop(y)))


def _cubes(ties: str) -> Column:
    """The sum of t*t - 1, exactly: cubes of millions pass 64 bits."""
    t = F.col(ties).cast("decimal(19, 0)")
    return F.sum(t * t - 1).cast("double")


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row (rho, n). Null below five pairs, and without variance. NaN ranks above all numbers."""
    pairs = checkpoint(rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null"))
    ranked = global_rank(global_rank(pairs, "x", "rx"), "y", "ry")
    out = ranked.agg(_rho("rx", "ry").alias("rho"), F.count("*").alias("n"))
    return out.select(F.when(F.col("n") >= 5, F.col("rho")).alias("rho"), "n")


def with_p(spearmans: DataFrame) -> DataFrame:
    """With the two-sided p-value."""
    return spearmans.withColumn("p", stats.columns()["spearman_p"]("rho", "n"))


def spearman_by(rows: DataFrame, key: str, x: str, y: str, least: int = 8) -> DataFrame:
    """(key, rho, n) for keys with ``least`` pairs and variance in both."""
    pairs = rows.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=[key]).where("x is not null and y is not null")
    ranked = pairs.withColumns({"rx": average_rank("x", key), "ry": average_rank("y", key)})
    out = ranked.groupBy(key).agg(_rho("rx", "ry").alias("rho"), F.count("*").alias("n"))
    return out.where((F.col("n") >= least) & F.col("rho").isNotNull())


def spearman_summary(rows: DataFrame, key: str, x: str, y: str, least: int = 8) -> DataFrame:
    """Median rho, the share above zero and the number of companies."""
    each = checkpoint(spearman_by(rows, key, x, y, least).select("rho"))
    found = each.agg(F.avg((F.col("rho") > 0).cast("double")).alias("share_positive"), F.count("*").alias("companies"))
    median = quantiles(each, "rho", [0.5]).select(F.col("q")[0].alias("median_rho"))
    return found.join(F.broadcast(median)).select("median_rho", "share_positive", "companies")


def kruskal(rows: DataFrame, feature: str, group: str) -> DataFrame:
    """One row (h, groups, n): H with the correction for ties, null below two groups or if all are tied."""
    pairs = checkpoint(rows.select(F.col(feature).cast("double").alias("x"), F.col(group).alias("g")).dropna())
    ranked = global_rank(pairs, "x", "r")
    sums = ranked.groupBy("g").agg(F.sum("r").alias("s"), F.count("*").alias("k"), _cubes("r_ties").alias("t"))
    total = sums.agg(
        F.sum(F.col("s") * F.col("s") / F.col("k")).alias("q"), F.sum("k").cast("double").alias("n"), F.sum("t").cast("double").alias("t"), F.count("*").alias("groups")
    )
    n = F.col("n")
    raw = F.try_divide(12 * F.col("q"), n * (n + 1)) - 3 * (n + 1)
    fix = 1 - F.try_divide(F.col("t"), n * n * n - n)
    return total.select(F.when((F.col("groups") >= 2) & (fix > 0), F.try_divide(raw, fix)).alias("h"), "groups", n.cast("long").alias("n"))


def mann_whitney(rows: DataFrame, value: str, first: Column, least: int = 5) -> DataFrame:
    """One row (u, n1, n2, ties) of the rows where ``first`` holds against the others; u is null below ``least`` a side."""
    pairs = checkpoint(rows.select(F.col(value).cast("double").alias("x"), first.alias("g")).dropna())
    ranked = global_rank(pairs, "x", "r")
    out = ranked.agg(
        F.sum(F.when(F.col("g"), F.col("r"))).alias("s"),
        F.count(F.when(F.col("g"), 1)).alias("n1"),
        F.count(F.when(~F.col("g"), 1)).alias("n2"),
        _cubes("r_ties").alias("ties"),
    )
    u = F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2
    return out.select(F.when((F.col("n1") >= least) & (F.col("n2") >= least), u).alias("u"), "n1", "n2", "ties")


def zscored(rows: DataFrame, groups: list[str], columns: dict[str, str]) -> DataFrame:
    """W04 for large groups: ``columns`` (name: column) by group, rounded so that equal days tie; null where the column is.

    Means and deviations are sums, made before anything is shuffled.
    """
    made = [f(c).alias(f"_{n}_{name}") for name, c in columns.items() for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    sums = rows.groupBy(*groups).agg(*made)
    out = {}
    for name, c in columns.items():
        sd, gap = F.col(f"_sd_{name}"), F.col(c) - F.col(f"_mean_{name}")
        out[name] = F.round(F.when(sd > 0, F.try_divide(gap, sd)).otherwise(F.col(c) * 0.0), 9)
    return rows.join(sums, groups).withColumns(out).drop(*sums.drop(*groups).columns)


def panel_blocks(blocks: DataFrame, key: str = "ticker") -> DataFrame:
    """For each ``title`` of (title, key, x, y) pooled, within-company and per-company rank correlation, as rows (title, metric, rho, p, n)."""
    blocks = checkpoint(blocks)
    z = zscored(blocks, ["title", key], {"zx": "x", "zy": "y"})
    pairs = blocks.select("title", F.lit("pooled").alias("metric"), F.lit(None).cast("string").alias("of"), "x", "y")
    pairs = pairs.unionByName(z.select("title", F.lit("within").alias("metric"), F.lit(None).cast("string").alias("of"), F.col("zx").alias("x"), F.col("zy").alias("y")))
    pairs = pairs.unionByName(blocks.select("title", F.lit("each").alias("metric"), F.col(key).cast("string").alias("of"), "x", "y"))
    rho = checkpoint(rankings.study(["title", "metric", "of"], pairs, nan=True)[0])
    whole = with_p(rho.where("metric <> 'each'")).select("title", "metric", "rho", "p", "n")
    each = rho.where("metric = 'each' and n >= 8 and rho is not null")
    none = F.lit(None).cast("double").alias("p")
    # titles without such a company have a row of nulls
    titles = blocks.select("title").distinct()
    share = titles.join(each.groupBy("title").agg(F.avg((F.col("rho") > 0).cast("double")).alias("rho"), F.count("*").alias("n")), "title", "left")
    share = share.withColumn("n", F.coalesce("n", F.lit(0)))
    median = rankings.quantiles_by(each, ["title"], [0.5], "rho").select("title", F.col("q")[0].alias("median"))
    median = share.join(median, "title", "left").select("title", F.lit("median").alias("metric"), F.col("median").alias("rho"), none, "n")
    return whole.unionByName(median).unionByName(share.select("title", F.lit("share_positive").alias("metric"), "rho", none, "n"))


def coverage_sweep(panel: DataFrame, thresholds: tuple[int, ...] = (1, 3, 5, 10, 20), key: str = "ticker") -> DataFrame:
    """Within-company correlation of negativity and |return| over company-days with at least so many articles.

    A row for each threshold that a day reaches; rho is null below 30 days or five companies.
    z-scores are made anew in each subset, and rounded so that equal days tie.
    """
    panel = panel.select(key, "news_n", "news_neg", "abs_ret")
    each = checkpoint(panel.withColumn("min_n", F.explode(F.array(*map(F.lit, thresholds)))).where("news_n >= min_n"))
    counts = each.groupBy("min_n").agg(F.count("*").alias("days"), F.countDistinct(key).alias("companies"))
    z = zscored(each, ["min_n", key], {"x": "news_neg", "y": "abs_ret"})
    rho = rankings.study(["min_n"], z.select("min_n", "x", "y"), nan=True)[0].select("min_n", "rho")
    enough = (F.col("days") >= 30) & (F.col("companies") >= 5)
    return counts.join(rho, "min_n", "left").select("min_n", "days", "companies", F.when(enough, F.col("rho")).alias("rho"))


def analyze_panel(panel: DataFrame, key: str = "ticker") -> DataFrame:
    """All blocks of the panel study as rows (title, metric, rho, p, n)."""
    panel = checkpoint(panel.select(key, "news_n", "news_neg", "abs_ret", "fwd_vol"))
    top = P.well_covered(panel, 50, key)
    blocks = [
        (panel, "news_neg", "abs_ret", "co-movement: sentiment"),
        (panel, "news_n", "abs_ret", "co-movement: volume"),
        (panel, "news_neg", "fwd_vol", "lead: sentiment"),
        (panel, "news_n", "fwd_vol", "lead: volume"),
        (top, "news_neg", "abs_ret", "well covered: sentiment"),
        (top, "news_n", "abs_ret", "well covered: volume"),
    ]
    out = []
    for rows, x, y, title in blocks:
        rows = rows.where("fwd_vol is not null") if y == "fwd_vol" else rows
        out.append(rows.select(F.lit(title).alias("title"), key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    return panel_blocks(reduce(DataFrame.unionByName, out), key)
