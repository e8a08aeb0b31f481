"""Backtests as windows: a decision on a day earns the return to the next one."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr, stats
from tidemark.operators import pit

BPS = 5.0


def momentum(bars: int = 20) -> Callable[[str, str], Column]:
    """A rule as an expression: long if the close is above that of ``bars`` rows ago."""

    def position(key: str, day: str) -> Column:
        before = F.lag("close", bars).over(Window.partitionBy(key).orderBy(day))
        return F.when(F.col("close") > before, 1.0).otherwise(0.0)

    return position


def prefix_rule(rule: Callable[[pd.DataFrame], float], key: str = "ticker", day: str = "date") -> Callable[[DataFrame], DataFrame]:
    """A rule as Python: it gets a key's rows up to a day, oldest first, and returns a position.

    For rules that no expression gives; a key's rows meet in one task.
    """

    def decided(bars: DataFrame) -> DataFrame:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(day)
            rows["position"] = [float(rule(rows.iloc[: i + 1])) for i in range(len(rows))]
            return rows

        schema = ", ".join(f"{n} {t}" for n, t in [*bars.dtypes, ("position", "double")])
        return bars.groupBy(key).applyInPandas(run, schema)

    return decided


def backtest(
    bars: DataFrame, position: Callable[[str, str], Column] | Column, start: str, end: str, bps: float = BPS, key: str = "ticker", day: str = "date", *by: str
) -> DataFrame:
    """C16 (W11, W12): (key, date, position, raw_return, cost, net_return) for decisions from ``start`` on.

    ``position`` is an expression over rows up to the current one. The row of a
    decision carries the next day's date; a return that touches a bad close is
    0; positions start flat, and a change costs on the row where it is made.
    Rows after ``end`` aren't seen.
    """
    keys = [key, *by]
    order = Window.partitionBy(*keys).orderBy(day)
    seen = bars.where(F.col(day) <= F.to_date(F.lit(end)))
    wanted = position(key, day) if callable(position) and not isinstance(position, Column) else position
    rows = seen.withColumn("position", wanted).withColumns({"_next": F.lead(day).over(order), "_close": F.lead("close").over(order)})
    rows = rows.where((F.col(day) >= F.to_date(F.lit(start))) & F.col("_next").isNotNull())
    good = (F.col("close") > 0) & (F.col("_close") > 0)
    raw = F.when(good, F.ln(F.col("_close")) - F.ln(F.col("close"))).otherwise(0.0)
    before = F.lag("position", 1, 0.0).over(order)
    out = rows.withColumns({"raw_return": raw, "cost": expr.trade_cost(before, F.col("position"), bps), "changed": (F.col("position") != before)})
    return out.select(*keys, F.col("_next").alias(day), "position", "raw_return", "cost", (F.col("raw_return") * F.col("position") - F.col("cost")).alias("net_return"), "changed")


def totals(days: DataFrame, *keys: str) -> DataFrame:
    """A24."""
    return days.groupBy(*keys).agg(
        F.count("*").alias("days"), F.sum("net_return").alias("net_return"), F.sum("cost").alias("total_cost"), F.count(F.when(F.col("changed"), 1)).alias("n_position_changes")
    )


def report(days: DataFrame, *keys: str) -> DataFrame:
    """C17: moments, annualised Sharpe ratio and PSR of net returns; keys with under two days go."""
    found = pit.moments(days, *keys, column="net_return").where("n >= 2")
    psr = stats.columns()["psr"]
    return found.join(totals(days, *keys).select(*keys, "total_cost", "n_position_changes"), list(keys)).withColumns(
        {"annualised_sharpe": expr.annualised(F.col("sharpe")), "psr": psr("n", "sharpe", "skewness", "kurtosis", F.lit(0.0))}
    )


def trials(days: DataFrame, key: str = "ticker", trial: str = "threshold") -> DataFrame:
    """For each key the best of its trials (the first of the greatest Sharpe ratios), its PSR alone and deflated by the number of trials."""
    each = pit.moments(days, key, trial, column="net_return").where("n >= 2")
    best = each.groupBy(key).agg(
        F.count("*").alias("n_trials"),
        F.var_pop("sharpe").alias("trial_variance"),
        F.max_by(F.struct(trial, "n", "sharpe", "skewness", "kurtosis"), F.struct("sharpe", -F.col(trial))).alias("b"),
    )
    c = stats.columns()
    moments = [F.col(f"b.{x}") for x in ("n", "sharpe", "skewness", "kurtosis")]
    out = best.withColumn("luck", c["expected_max_sharpe"](F.col("n_trials"), F.col("trial_variance")))
    return out.select(
        key, "n_trials", "trial_variance", F.col(f"b.{trial}").alias(f"best_{trial}"), F.col("b.sharpe").alias("best_sharpe"), c["psr"](*moments, F.lit(0.0)).alias("psr"), c["psr"](*moments, F.col("luck")).alias("dsr")
    )
