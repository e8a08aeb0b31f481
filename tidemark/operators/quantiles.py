"""Exact quantiles of a whole column without all its values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.storage import checkpoint


def cumulated(rows: DataFrame, column: str, ranges: int = 64) -> DataFrame:
    """(_v, _n, _upto): every distinct value that isn't null, its rows, and the rows up to it.

    Values are counted, dealt into ranges by quantiles (a bounded sketch), and
    summed inside them after the totals of lower ranges. What one task holds is
    a range of distinct values.
    """
    counts = checkpoint(rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n")))
    cuts = counts.agg(F.percentile_approx("_v", [k / ranges for k in range(1, ranges)], 1000).alias("_cuts"))
    ranged = counts.join(F.broadcast(cuts)).withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))), F.lit(0))).drop("_cuts")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range
    totals = ranged.groupBy("_range").agg(F.sum("_n").alias("_t")).select(
        F.col("_range").alias("_r"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("_inside", F.sum("_n").over(inside))
        .join(F.broadcast(totals), F.col("_range") == F.col("_r"))
        .select("_v", "_n", (F.col("_before") + F.col("_inside")).alias("_upto"))
    )


def quantiles(rows: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row (q: array of doubles), with linear interpolation; its entries are null where no value is.

    ``rows`` is read once. Nulls don't count.
    """
    values = cumulated(rows.select(F.col(column).cast("double").alias("_x")), "_x")
    total = values.agg(F.max("_upto").alias("_rows"))
    found, out = [], []
    for k, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("_rows") - 1)
        for name, place in ((f"_low{k}", F.floor(at)), (f"_high{k}", F.ceil(at))):
            found.append(F.min(F.when(F.col("_upto") > place, F.col("_v"))).alias(name))
        low, high = F.col(f"_low{k}"), F.col(f"_high{k}")
        out.append(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high))
    each = values.join(F.broadcast(total)).agg(F.max("_rows").alias("_rows"), *found)
    return each.select(F.array(*out).alias("q"))
