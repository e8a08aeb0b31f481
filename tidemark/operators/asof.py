"""As-of joins in two levels, so that no task gets all rows of a key.

Time is cut into buckets. The first row of each bucket is carried to the buckets
before it by a pass over bucket rows, a few for each key; then each key and
bucket is merged by itself: left rows, right rows, and what comes first after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a bucket.
WIDTH = 32
_DAY = 86_400_000_000


def _number(column: str, kind: str, forward: bool) -> Column:
    """Days of dates, microseconds of times; counted down where the join looks back."""
    at = F.datediff(column, F.lit("1970-01-01")).cast("long") if kind == "date" else F.unix_micros(F.col(column).cast("timestamp"))
    return at if forward else -at


def asof(
    left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, take: list[str], forward: bool = True, how: str = "inner", days: int = WIDTH, parts: int = 1
) -> DataFrame:
    """Each row of ``left`` with ``take`` of the first row of ``right`` at or after it (at or before it if not ``forward``).

    Both times are dates, or both times of day. Of several right rows at one
    moment the smallest values count. Left rows without a key, a time or a match
    go, or stay with nulls if ``how`` is ``left``. Left rows of one key and
    bucket are dealt into ``parts``, for tables that have very many of them.
    """
    kind = dict(left.dtypes)[at]
    if (kind == "date") != (dict(right.dtypes)[right_at] == "date"):
        raise ValueError("both sides need dates, or both times")
    width = days if kind == "date" else days * _DAY
    bucket = F.floor(F.col("_o") / F.lit(width)).cast("long") if kind == "date" else F.expr(f"(_o - pmod(_o, {width}L)) div {width}L")
    known = right.where(F.col(key).isNotNull() & F.col(right_at).isNotNull()).withColumn("_o", _number(right_at, dict(right.dtypes)[right_at], forward))
    first = known.groupBy(key, "_o").agg(F.min(F.struct(*take)).alias("_v")).withColumn("_b", bucket)
    first = first.select(key, "_b", "_o", F.struct("_o", "_v").alias("_found"))
    rows = left.select(F.struct(*left.columns).alias("_row"), F.col(key), _number(at, kind, forward).alias("_o")).withColumn("_b", bucket)
    placed = rows.where(F.col(key).isNotNull() & F.col("_o").isNotNull())
    # a row for each key and bucket that either side has
    heads = first.groupBy(key, "_b").agg(F.min("_found").alias("_head"))
    heads = heads.unionByName(placed.select(key, "_b").distinct().withColumn("_head", F.lit(None).cast(dict(heads.dtypes)["_head"])))
    # from the last on: a frame that grows takes in each row once, one that shrinks adds up the rest for each row
    later = Window.partitionBy(key).orderBy(F.desc("_b")).rangeBetween(Window.unboundedPreceding, -1)
    next_ = heads.withColumn("_found", F.min("_head").over(later)).where("_head is null and _found is not null")
    ends = next_.select(key, "_b", ((F.col("_b") + 1) * width - 1).alias("_o"), "_found")
    nothing = F.lit(None).cast(dict(rows.dtypes)["_row"])
    facts = first.unionByName(ends).withColumn("_row", nothing)
    none = F.lit(None).cast(dict(first.dtypes)["_found"])
    if parts > 1:
        facts = facts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        placed = placed.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(parts)).cast("int"))
    both = placed.withColumn("_found", none).unionByName(facts)
    here = Window.partitionBy(key, "_b", *(["_part"] if parts > 1 else [])).orderBy(F.desc("_o")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_found", F.min("_found").over(here)).where("_row is not null").select("_row", "_found")
    if how == "left":
        out = out.unionByName(rows.where(F.col(key).isNull() | F.col("_o").isNull()).select("_row", none.alias("_found")))
    else:
        out = out.where("_found is not null")
    return out.select("_row.*", *[F.col(f"_found._v.{c}").alias(c if c not in left.columns else f"right_{c}") for c in take])
