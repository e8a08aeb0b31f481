"""Exact similarity of shingle sets, which completes the near-duplicates of SimHash.

The prefix filter finds all pairs: if the shingles of all texts are put in one
order, two sets of a similarity of 4/5 or more share one of the first
``n // 5 + 1`` shingles of each. The order is by the number of sets that have a shingle, so a set with ``n // 5 + 1``
shingles of its own shares nothing, and a line of many texts is no meeting place.

Most sets have so many shingles of their own among three tenths of all hashes,
and only these are counted over all texts. The sets that are left are counted
in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import HOT, shingle_hashes, small, split_join, written

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers, so that the bound itself counts.
OVER, UNDER = 4, 5
#: Tenths of the hashes that are counted over all texts.
TENTHS = 3


def majority(blocks: list[np.ndarray] | Iterator[np.ndarray]) -> int:
    """SimHash of blocks of hashes: the bits that are set in over half of them; 0 for none."""
    counts, total = np.zeros(64, np.int64), 0
    for block in blocks:
        counts += np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(block)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def sets(texts: DataFrame, shingle: int = SHINGLE, tenths: int = 10) -> DataFrame:
    """``(id, node, n, fp, sh)``: a hash of the set of shingles, its size, the SimHash, and ``tenths`` of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            nodes, sizes, fps, held = [], [], [], []
            for raw in batch.column(1).to_pylist():
                blocks = list(shingle_hashes(raw or b"", shingle))
                own = np.unique(np.concatenate(blocks)) if blocks else np.array([], np.uint64)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), 42))
                sizes.append(len(own))
                fps.append(majority(blocks))
                held.append(own.view(np.int64) if tenths == 10 else own[own % np.uint64(10) < tenths].view(np.int64))
            ends = np.cumsum([0, *map(len, held)])
            flat = np.concatenate(held) if held else np.array([], np.int64)
            sh = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat, pa.int64())).cast(pa.list_(pa.int64()))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed(nodes), pa.array(sizes, pa.int32()), signed(fps), sh], names=["id", "node", "n", "fp", "sh"])

    narrow = texts.select("id", F.col("text").cast("binary").alias("raw"))
    return narrow.mapInArrow(run, "id long, node long, n int, fp long, sh array<long>")


def fits(x: Column, y: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(x, y) * UNDER >= F.greatest(x, y) * OVER


def _prefix_size() -> Column:
    return (F.col("n") * (UNDER - OVER) / UNDER).cast("int") + 1


def _hot(found: DataFrame) -> DataFrame:
    """``found`` (with t, the rows of a key) as a table, with ``hot`` for at most ``HOT`` of its keys."""
    found = written(found)
    total = found.agg(F.sum("t").alias("t")).collect()[0]["t"] or 0
    return found.withColumn("hot", F.col("t") > total / HOT)


def with_company(found: DataFrame, one: DataFrame) -> DataFrame:
    """Of ``one`` (node, id, n), the sets that can be similar to another. ``found`` has a part of each set."""
    keys = found.select("node", F.explode("sh").alias("key"))
    holders = keys.groupBy("key").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    alone = holders.where(F.col("node") == F.col("last")).groupBy("node").agg(F.count("*").alias("alone"))
    kept = one.join(alone, "node", "left").where(F.coalesce("alone", F.lit(0)) < _prefix_size())
    return written(kept.where("n > 0").select("node", "id", "n"))


def prefixes(full: DataFrame) -> DataFrame:
    """``(key, node, n, alone, place)``: the shingles of prefixes that several sets have, and their places in the order.

    Before them in the order are the ``alone`` shingles that no other set has.
    """
    keys = full.select("node", "n", F.explode("sh").alias("key"))
    holders = keys.groupBy("key").agg(F.count("*").alias("t")).where("t > 1")
    shared = split_join(keys, _hot(holders), ["key"], F.col("hot")).select("key", "node", "n", "t")
    own = Window.partitionBy("node")
    alone = F.col("n") - F.count("*").over(own)
    held = shared.withColumn("alone", alone.cast("int")).withColumn("place", F.col("alone") + F.row_number().over(own.orderBy("t", "key")))
    return written(held.where(F.col("place") <= _prefix_size()).select("key", "node", "n", "alone", "place"))


def similar(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Of nodes ``(a, b)``, the pairs whose whole sets ``full`` (node, n, sh) are similar enough."""
    x = full.select(F.col("node").alias("a"), F.col("n").alias("an"))
    y = full.select(F.col("node").alias("b"), F.col("n").alias("bn"))
    pairs = written(pairs.distinct().join(x, "a").join(y, "b").where(fits(F.col("an"), F.col("bn"))).select("a", "b"))
    first, second = written(pairs.select("a").distinct()), written(pairs.select("b").distinct())
    left = full.select(F.col("node").alias("a"), F.col("sh").alias("x")).join(small(first), "a", "left_semi")
    right = full.select(F.col("node").alias("b"), F.col("sh").alias("y")).join(small(second), "b", "left_semi")
    both = F.size(F.array_intersect("x", "y"))
    enough = both * (OVER + UNDER) >= (F.size("x") + F.size("y")) * OVER
    return written(pairs.join(left, "a").join(right, "b").where(enough).select("a", "b"))


def meeting_places(held: DataFrame) -> DataFrame:
    """``(key, hub, hot)`` of the shingles that several prefixes have; the hub is a set with few shingles of its own.

    Of a family of copies with edits that is one with few edits, which most others resemble.
    """
    places = held.groupBy("key").agg(F.count("*").alias("t"), F.min_by("node", "alone").alias("hub"))
    return _hot(places.where("t > 1")).drop("t")


def star(held: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs of the hub of a place and each other member."""
    met = split_join(held.select("key", "node"), places, ["key"], F.col("hot"))
    return met.where("hub <> node").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()


def across(held: DataFrame, places: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of members of different groups that share a place and may be similar enough.

    What is linked needs no more pairs, so a large group of near copies costs
    as many pairs as it has members. Two similar sets meet at the first shingle
    they share; nothing before it is shared, so it and what follows it in both
    must be enough for the similarity. Pairs come only from shingles of which
    that holds, and these are all up to some place, the first one among them.
    """
    columns = ["key", "node", "n", "place"]
    members = split_join(held.select(*columns), places.select("key", "hot"), ["key"], F.col("hot")).drop("hot")
    rooted = written(members.join(roots, "node", "left").select(*columns, F.coalesce("root", "node").alias("root")))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    met = written(rooted.join(mixed, "key"))
    other = met.select("key", *(F.col(c).alias(f"b{c}") for c in ("node", "n", "place", "root")))
    after = F.least(F.col("n") - F.col("place"), F.col("bn") - F.col("bplace")) + 1
    enough = after * (OVER + UNDER) >= (F.col("n") + F.col("bn")) * OVER
    apart = (F.col("node") < F.col("bnode")) & (F.col("root") != F.col("broot"))
    return met.join(other, "key").where(apart & enough).select(F.col("node").alias("a"), F.col("bnode").alias("b")).distinct()
