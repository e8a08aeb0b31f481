"""Ranks, rank tests and quantiles of many columns and groups in one pass.

Columns to rank become rows (group, value, weight): a value that many rows share
is one row with their number. These are dealt into ranges of (group, value), so
a large group is split and small ones share a range; places inside a range follow
after the totals of the group's lower ranges. Ranks go back to the rows by a join
in which values of very many rows are broadcast.

Group columns are compared as they are, null with null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.storage import checkpoint

#: A value with over one in so many of all rows is hot; there can be no more such values.
HOT = 1000
#: Parts that the rows of hot values are dealt into.
SALT = 1024


def _joined(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner", hint: bool = False, more: tuple[str, str] | None = None) -> DataFrame:
    """``rows`` with the other columns of ``facts``; ``more`` names one more column of each that must be equal."""
    other = facts.withColumnsRenamed({k: f"_of{i}" for i, k in enumerate(keys)})
    on = [F.col(k).eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate(keys)]
    if more:
        on.append(F.col(more[0]) == F.col(more[1]))
    return rows.join(F.broadcast(other) if hint else other, reduce(Column.__and__, on), how).drop(*[f"_of{i}" for i in range(len(keys))])


def _real(column: str, nan: bool = False) -> Column:
    return F.col(column).isNotNull() & (F.lit(nan) | ~F.isnan(F.col(column).cast("double")))


def places(values: DataFrame, groups: list[str], value: str = "value", weight: str | None = None, nan: bool = False) -> DataFrame:
    """For each group and distinct value that is a number (or NaN, with ``nan``): ``n`` rows, ``upto`` rows up to it, and the group's ``total``."""
    real = values.where(_real(value, nan))
    n = F.sum(weight) if weight else F.count("*")
    counts = real.groupBy(*groups, F.col(value).alias("value")).agg(n.alias("n"))
    dealt = checkpoint(counts.repartitionByRange(*groups, "value").withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy(*groups)
    before = own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each group and range
    totals = dealt.groupBy(*groups, "_range").agg(F.sum("n").alias("_t"))
    totals = totals.select(*groups, "_range", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"), F.sum("_t").over(own).alias("total"))
    inside = Window.partitionBy(*groups, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranged = _joined(dealt.withColumn("_inside", F.sum("n").over(inside)), totals, [*groups, "_range"])
    return ranged.select(*groups, "value", "n", (F.col("_before") + F.col("_inside")).alias("upto"), "total")


def quantiles_by(values: DataFrame, groups: list[str], shares: list[float], value: str = "value") -> DataFrame:
    """(groups, n, q) for each group with a number: exact quantiles with linear interpolation."""
    found = places(values, groups, value)
    at = [F.lit(float(s)) * (F.col("total") - 1) for s in shares]
    first = lambda place: F.min(F.when(F.col("upto") > place, F.col("value").cast("double")))
    both = [c for k, a in enumerate(at) for c in (first(F.floor(a)).alias(f"_low{k}"), first(F.ceil(a)).alias(f"_high{k}"))]
    one = found.groupBy(*groups).agg(F.max("total").alias("total"), *both)
    out = []
    for k, a in enumerate(at):
        low, high = F.col(f"_low{k}"), F.col(f"_high{k}")
        out.append(F.when(low == high, low).otherwise((F.ceil(a) - a) * low + (a - F.floor(a)) * high))
    return one.select(*groups, F.col("total").alias("n"), F.array(*out).alias("q"))


def _ranked(rows: DataFrame, facts: DataFrame, keys: list[str], column: str, names: list[str]) -> DataFrame:
    """``rows`` with ``names`` of the fact of their group and value."""
    facts = facts.select(*keys, F.col("value").alias(column), *names, "n")
    every = facts.agg(F.sum("n").alias("_all"))
    hot = facts.join(F.broadcast(every)).where(F.col("n") * HOT > F.col("_all")).select(*keys, column, *[F.col(c).alias(f"_hot_{c}") for c in names])
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(SALT)) + 1
    met = _joined(rows, hot, [*keys, column], "left", hint=True)
    met = met.withColumn("_salt", F.when(F.col(f"_hot_{names[0]}").isNotNull(), spread).otherwise(0))
    met = _joined(met, facts.drop("n").withColumn("_none", F.lit(0).cast("long")), [*keys, column], "left", more=("_salt", "_none"))
    known = {c: F.coalesce(f"_hot_{c}", c) for c in names}
    return met.withColumns(known).drop("_salt", "_none", *[f"_hot_{c}" for c in names])


def study(groups: list[str], pairs: DataFrame | None = None, splits: DataFrame | None = None, nan: bool = False) -> tuple[DataFrame | None, DataFrame | None]:
    """All rank correlations and all tests between labels, from one ranking.

    ``pairs`` (groups, x, y) give (groups, rho, n), rho null below five pairs
    or without variance. ``splits`` (groups, x, label) give for each label the
    sum ``s`` of its ranks, its rows ``k`` and ``t``, the sum of t*t - 1 over
    its rows, t being how many share a value. Rows with a null don't count, nor
    do those with NaN, unless ``nan`` ranks it above all numbers.
    """
    long, kept = [], {}
    if pairs is not None:
        rows = pairs.select(*groups, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(_real("x", nan) & _real("y", nan))
        kept["pairs"] = checkpoint(rows.groupBy(*groups, "x", "y").agg(F.count("*").alias("w")))
        sides = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("value")) for c in ("x", "y")])
        long.append(kept["pairs"].select(*groups, F.explode(sides).alias("s"), "w").select(*groups, "s.side", "s.value", "w"))
    if splits is not None:
        rows = splits.select(*groups, F.col("x").cast("double").alias("x"), "label").where(_real("x", nan) & F.col("label").isNotNull())
        kept["splits"] = checkpoint(rows.groupBy(*groups, "x", "label").agg(F.count("*").alias("w")))
        long.append(kept["splits"].select(*groups, F.lit("split").alias("side"), F.col("x").alias("value"), "w"))
    facts = places(reduce(DataFrame.unionByName, long), [*groups, "side"], weight="w", nan=nan)
    rank = F.col("upto") - (F.col("n") - 1) / 2
    facts = checkpoint(facts.select(*groups, "side", "value", "n", rank.alias("rank"), (rank - (F.col("total") + 1) / 2).alias("off")))
    correlations = sums = None
    if pairs is not None:
        rows = kept["pairs"]
        for c in ("x", "y"):
            own = facts.where(F.col("side") == c).withColumnRenamed("off", f"off_{c}")
            rows = _ranked(rows, own, groups, c, [f"off_{c}"])
        w, x, y = F.col("w"), F.col("off_x"), F.col("off_y")
        one = rows.groupBy(*groups).agg(F.sum(w * x * y).alias("_xy"), F.sum(w * x * x).alias("_xx"), F.sum(w * y * y).alias("_yy"), F.sum("w").alias("n"))
        varied = (F.col("n") >= 5) & (F.col("_xx") > 0) & (F.col("_yy") > 0)
        correlations = one.select(*groups, F.when(varied, F.try_divide(F.col("_xy"), F.sqrt("_xx") * F.sqrt("_yy"))).alias("rho"), "n")
    if splits is not None:
        own = facts.where(F.col("side") == "split").withColumn("ties", F.col("n"))
        rows = _ranked(kept["splits"], own, groups, "x", ["rank", "ties"])
        w, ties = F.col("w"), F.col("ties").cast("decimal(19, 0)")  # cubes of millions pass 64 bits
        sums = rows.groupBy(*groups, "label").agg(F.sum(w * F.col("rank")).alias("s"), F.sum(w).alias("k"), F.sum(w * (ties * ties - 1)).cast("double").alias("t"))
    return correlations, sums


def kruskal_of(sums: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, h, labels, n); H with the correction for ties, null below two labels or if all are tied."""
    total = sums.groupBy(*groups).agg(
        F.sum(F.col("s") * F.col("s") / F.col("k")).alias("q"), F.sum("k").cast("double").alias("m"), F.sum("t").alias("t"), F.count("*").alias("labels")
    )
    m = F.col("m")
    raw = F.try_divide(12 * F.col("q"), m * (m + 1)) - 3 * (m + 1)
    fix = 1 - F.try_divide(F.col("t"), m * m * m - m)
    return total.select(*groups, F.when((F.col("labels") >= 2) & (fix > 0), F.try_divide(raw, fix)).alias("h"), "labels", m.cast("long").alias("n"))


def mann_whitney_of(sums: DataFrame, groups: list[str], first: str, least: int = 5) -> DataFrame:
    """(groups, u, n1, n2, ties) of the label ``first`` against all others; u is null below ``least`` rows a side."""
    own = F.col("label") == first
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0))
    out = sums.groupBy(*groups).agg(F.sum(F.when(own, F.col("s"))).alias("s"), count(own).alias("n1"), count(~own).alias("n2"), F.sum("t").alias("ties"))
    u = F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2
    return out.select(*groups, F.when((F.col("n1") >= least) & (F.col("n2") >= least), u).alias("u"), "n1", "n2", "ties")
