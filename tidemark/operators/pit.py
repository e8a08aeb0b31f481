"""Point in time: what was known on a day, and nothing after it."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import asof


class PointInTime:
    """A table of dated rows that is only read through a cutoff."""

    def __init__(self, rows: DataFrame, key: str = "ticker", day: str = "date"):
        self._rows, self._key, self._day = rows, key, day

    def as_of(self, day: datetime.date | str) -> DataFrame:
        """Rows of the day and before (T04: order is asked for where it is needed)."""
        return self._rows.where(F.col(self._day) <= F.to_date(F.lit(str(day))))

    def last_before(self, cutoffs: DataFrame, at: str, take: list[str], days: int = asof.WIDTH) -> DataFrame:
        """The last row of the key at or before each cutoff (key, ``at``, ...), nulls where there is none; rows after a cutoff are never seen."""
        return asof.asof(cutoffs, self._rows, self._key, at, self._day, take, forward=False, how="left", days=days)

    def bars(self, key: str, day: datetime.date | str) -> DataFrame:
        """A key's rows up to a day, oldest first; an unknown key has none."""
        return self.as_of(day).where(F.col(self._key) == key).orderBy(self._day)

    def lookback(self, n: int, day: datetime.date | str) -> DataFrame:
        """Each key's last ``n`` rows up to a day; fewer if there are fewer."""
        newest = Window.partitionBy(self._key).orderBy(F.desc(self._day))
        return self.as_of(day).withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")

    def expanding(self, *columns: str) -> DataFrame:
        """Count, mean and deviation of all rows up to each row."""
        past = Window.partitionBy(self._key).orderBy(self._day).rowsBetween(Window.unboundedPreceding, 0)
        out = {}
        for c in columns:
            out |= {f"{c}_n": F.count(c).over(past), f"{c}_mean": F.avg(c).over(past), f"{c}_sd": F.stddev_pop(c).over(past)}
        return self._rows.withColumns(out)


def pair_returns(key: str = "ticker", day: str = "date", close: str = "close") -> Column:
    """The log return to the row before; null if either close isn't positive."""
    before = F.lag(close).over(Window.partitionBy(key).orderBy(day))
    return F.when((F.col(close) > 0) & (before > 0), F.ln(F.col(close)) - F.ln(before))


def log_returns(bars: DataFrame, key: str = "ticker", day: str = "date") -> DataFrame:
    """Pairs that touch a bad close go; gaps aren't bridged."""
    return bars.withColumn("ret", pair_returns(key, day)).where("ret is not null").select(key, day, "ret")


def moments(returns: DataFrame, *keys: str, column: str = "ret") -> DataFrame:
    """N, mean, population deviation, Sharpe ratio, skewness and raw kurtosis, with the values of a constant series."""
    sd = F.coalesce(F.stddev_pop(column), F.lit(0.0))
    mean = F.coalesce(F.avg(column), F.lit(0.0))
    varied = sd > 0
    return returns.groupBy(*keys).agg(
        F.count(column).alias("n"),
        mean.alias("mean"),
        sd.alias("sd"),
        F.when(varied, F.try_divide(mean, sd)).otherwise(0.0).alias("sharpe"),
        F.when(varied, F.skewness(column)).otherwise(0.0).alias("skewness"),
        F.when(varied, F.kurtosis(column) + 3).otherwise(3.0).alias("kurtosis"),
    )
