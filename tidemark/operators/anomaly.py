"""Anomaly detection: z-scores within companies, and an isolation forest over them.

The forest is that of Liu, Ting and Zhou (2008). Each tree sees 256 rows, so the
forest needs a bounded sample (``TREES * SAMPLE`` rows); it is drawn by hashes
of keys, so partitions don't change it. All rows are scored, in Arrow batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import panel as P
from tidemark.operators.quantiles import quantiles
from tidemark.sources.storage import checkpoint

TREES, SAMPLE, SEED = 300, 256, 42
CONTAMINATION = 0.03
ALERT_TYPE = "news_market_anomaly"


def mean_depth(n: int) -> float:
    """The mean depth of a search in a tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as arrays: feature (-1: a leaf), threshold, left child (the right one follows), and a leaf's depth."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    size: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Minus the anomaly score: the lower, the more unusual."""
        total = np.zeros(len(x))
        for feature, threshold, child, depth in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                node = at[rows]
                at[rows] = child[node] + (x[rows, feature[node]] >= threshold[node])
            total += depth[at]
        return -(2.0 ** (-total / len(self.trees) / max(mean_depth(self.size), 1e-12)))


def grow(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree that parts rows at random values of random features until they are alone or at the depth limit."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[list[float]] = [[-1, 0.0, 0, 0.0]]
    open_nodes = [(0, np.arange(len(x)), 0)]
    while open_nodes:
        at, rows, depth = open_nodes.pop()
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        free = np.flatnonzero(high > low)
        if depth >= limit or len(free) == 0:
            nodes[at][3] = depth + mean_depth(len(rows))
            continue
        f = int(rng.choice(free))
        cut = float(rng.uniform(low[f], high[f]))
        right = x[rows, f] >= cut
        nodes[at][:3] = [f, cut, len(nodes)]
        for part in (rows[~right], rows[right]):
            open_nodes.append((len(nodes), part, depth + 1))
            nodes.append([-1, 0.0, 0, 0.0])
    table = np.array(nodes)
    return table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3]


def fit(rows: DataFrame, features: list[str], keys: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest | None:
    """A forest over a bounded sample of ``rows``; None without rows."""
    n = rows.count()
    if not n:
        return None
    most = trees * sample
    draw = F.xxhash64(F.lit(seed), *keys)
    share = min(1.0, 1.2 * most / n + 1e-3)
    picked = rows.where(F.pmod(draw, F.lit(1 << 30)) < int(share * (1 << 30))).select(draw.alias("draw"), *features)
    data = np.array([[float(r[f]) for f in features] for r in picked.orderBy("draw", *features).limit(most).collect()], float).reshape(-1, len(features))
    rng = np.random.default_rng(seed)
    size = min(sample, len(data))
    return Forest([grow(data[rng.choice(len(data), size, replace=False)], rng) for _ in range(trees)], size) if size else None


def score(rows: DataFrame, forest: Forest, features: list[str]) -> DataFrame:
    @F.pandas_udf("double")
    def scored(*columns: pd.Series) -> pd.Series:
        return pd.Series(forest.scores(np.column_stack([c.to_numpy(float) for c in columns])))

    return rows.withColumn("score", scored(*features))


def run_detection(features: DataFrame, contamination: float = CONTAMINATION, key: str = "ticker", trees: int = TREES) -> DataFrame:
    """Flagged company-days with score, severity and text, the most unusual first.

    Flagged are rows below the contamination quantile of the scores.
    """
    z = [f"z_{f}" for f in P.FEATURES]
    rows = checkpoint(P.severities(P.zscores(features, key)))
    forest = fit(rows, z, [key, "day"], trees)
    if forest is None:
        return rows.withColumn("score", F.lit(0.0)).withColumn("explanation", F.lit("")).limit(0)
    scored = checkpoint(score(rows, forest, z))
    cut = quantiles(scored, "score", [contamination]).select(F.col("q")[0].alias("_cut"))
    flagged = scored.join(F.broadcast(cut)).where(F.col("score") < F.col("_cut")).drop("_cut")
    words = X.sigma_text(F.col(key), F.col("day").cast("string"), F.array(*z), F.col("score"))
    return flagged.withColumn("explanation", words).orderBy("score", key, "day")


def alerts(flagged: DataFrame) -> DataFrame:
    """Flagged company-days as alert rows."""
    return flagged.select(
        "company_id", F.col("day").cast("timestamp").alias("triggered_at"), F.lit(ALERT_TYPE).alias("alert_type"), "severity", "explanation", F.lit(False).alias("resolved")
    )


def severity_counts(rows: DataFrame) -> DataFrame:
    """One row; what is neither high nor medium counts as low."""
    count = lambda name: F.count(F.when(F.col("severity") == name, 1))
    return rows.agg(F.count("*").alias("total"), count("high").alias("high"), count("medium").alias("medium")).withColumn(
        "low", F.col("total") - F.col("high") - F.col("medium")
    )


def first_company(news: DataFrame, key: str = "ticker") -> DataFrame:
    """The company of a ticker (the smallest id)."""
    return news.groupBy(key).agg(F.min("company_id").alias("company_id"))


def first_tickers(rows: DataFrame, n: int, key: str = "ticker") -> DataFrame:
    """The first distinct tickers in order."""
    return rows.select(key).distinct().orderBy(key).limit(n)


def ranked(rows: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """The first ``n`` rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)
