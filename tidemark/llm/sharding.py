"""Sharding by a Feistel permutation with cycle walking. Native: SQL functions only.

Rows get global numbers 0..n-1, the permutation shuffles the numbers, and a
permuted number p goes to shard ``p % shards``, slot ``p div shards``: shard
sizes differ by one row at most, and slots have no gaps. ``place`` computes the
same shard and slot from a row number alone, without any data.

Global numbers need no sort of the table: keys are dealt into hash buckets,
bucket totals (at most ``BUCKETS`` rows) become offsets, and each bucket numbers
its own keys. Equal rows are counted before the shuffle, so a row that is
repeated a billion times moves as one row with a count.
"""

from __future__ import annotations

import struct

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
ROUNDS = 6
#: Steps of a cycle walk. Outside numbers are under sqrt(n)+1 of n, so walks
#: longer than this can't occur for n up to 4096 and have odds of n**-32 above.
WALK = 64
#: Copies of a row are made in runs of this many.
RUN = 1024


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def _rounds(value: Column, a: Column, b: Column, seed: int) -> Column:
    """``ROUNDS`` (an even number) Feistel rounds on pairs of Z_a x Z_b."""
    state = F.struct(_div(value, b).alias("u"), (value % b).alias("v"), a.alias("mu"), b.alias("mv"))
    return F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.lit(ROUNDS).cast("long")),
        state,
        lambda s, i: F.struct(
            s["v"].alias("u"),
            ((s["u"] + F.pmod(F.xxhash64(s["v"], i + F.lit(seed).cast("long")), s["mu"])) % s["mu"]).alias("v"),
            s["mv"].alias("mu"),
            s["mu"].alias("mv"),
        ),
        lambda s: s["u"] * s["mv"] + s["v"],
    )


def permuted(number: Column, n: Column, a: Column, b: Column, seed: int = 0) -> Column:
    """The place of ``number`` among 0..n-1; a*b is at least n, and each number gets another place."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        _rounds(number, a, b, seed),
        lambda p, _: F.when(p < n, p).otherwise(_rounds(p, a, b, seed)),
    )


def number_rows(rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``rows`` counted by ``keys``: each key with ``copies``, ``first_number`` and the total ``n_rows``.

    The numbers of a key are first_number .. first_number + copies - 1. They
    depend on the multiset of keys alone, not on partitions or files.
    """
    counted = rows.groupBy(*keys).agg(F.count("*").alias("copies")).withColumn(
        "_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    )
    # one row for each bucket: a bounded table, so one task can sum it up
    sums = Window.orderBy("_bucket")
    offsets = (
        counted.groupBy("_bucket")
        .agg(F.sum("copies").alias("_n"))
        .select(
            F.col("_bucket").alias("_b"),
            (F.sum("_n").over(sums.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
            F.sum("_n").over(Window.partitionBy()).alias("n_rows"),
        )
    )
    inside = Window.partitionBy("_bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counted.withColumn("_upto", F.sum("copies").over(inside))
        .join(F.broadcast(offsets), F.col("_bucket") == F.col("_b"))
        .withColumn("first_number", F.col("_before") + F.col("_upto") - F.col("copies"))
        .drop("_bucket", "_b", "_before", "_upto")
    )


def shard(rows: DataFrame, keys: list[str], n_shards: int = 16, seed: int = 0) -> DataFrame:
    """Each row of ``rows`` (its ``keys`` alone) with ``shard`` and ``slot``.

    Counts of shards differ by one at most (the law ``rows``). Null keys are a
    key like any other, equal rows get different slots, an empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    numbered = number_rows(rows.select(*keys), keys)
    a = F.ceil(F.sqrt(F.col("n_rows").cast("double"))).cast("long")
    numbered = numbered.withColumn("_a", F.greatest(a, F.lit(1).cast("long"))).withColumn(
        "_b", _div(F.col("n_rows") + F.col("_a") - 1, F.col("_a"))
    )
    runs = numbered.withColumn(
        "_run", F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("copies") - 1, F.lit(RUN).cast("long"))))
    )
    each = runs.withColumn(
        "_k",
        F.explode(F.sequence(F.col("_run") * RUN, F.least(F.col("copies"), (F.col("_run") + 1) * RUN) - 1)),
    )
    place = permuted(F.col("first_number") + F.col("_k"), F.col("n_rows"), F.col("_a"), F.col("_b"), seed)
    return (
        each.withColumn("_p", place)
        .withColumn("shard", (F.col("_p") % n_shards).cast("int"))
        .withColumn("slot", _div(F.col("_p"), F.lit(n_shards).cast("long")))
        .select(*keys, F.col("n_rows"), (F.col("first_number") + F.col("_k")).alias("row_number"), "shard", "slot")
    )


def place(number: int, n: int, n_shards: int = 16, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number, computed without data."""

    def rounds(p: int) -> int:
        u, v, mu, mv = p // b, p % b, a, b
        for i in range(1, ROUNDS + 1):
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), 42)
            h = xxhash.xxh64_intdigest(struct.pack("<q", i + seed), h)
            h -= (h >> 63) << 64
            u, v, mu, mv = v, (u + h % mu) % mu, mv, mu
        return u * mv + v

    a = max(1, _ceil_sqrt(n))
    b = (n + a - 1) // a
    p = rounds(number)
    while p >= n:
        p = rounds(p)
    return p % n_shards, p // n_shards


def _ceil_sqrt(n: int) -> int:
    return int(-(-(n**0.5) // 1))
