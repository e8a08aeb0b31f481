"""Benchmark decontamination by SimHash windows. Native: DataFrame functions only.

A text is held against every benchmark item with windows of the item's own
size. A window similar enough has an item's shingles, wherever they are in it,
and if moved to start at the first of them it loses none. So windows start at
the item shingles a text has, or end with the text; which item one is like is
for the fingerprints to say.

Each window gets a 64-bit SimHash of its word shingles. Multi-index Hamming
blocks find the items of that size: the bits are dealt into ``BLOCKS`` blocks,
two fingerprints within ``RADIUS`` bits are within ``RADIUS // BLOCKS`` bits in
one block at least, and an item is indexed under all values so near its own. So
every fingerprint within the radius is found; the exact similarity of weighted
shingles (sum of least counts over sum of greatest) then decides.

At a similarity of 0.8 about 15 % of the bits differ, whatever their number, so
blocks of any width must allow for so many flips that they prune little; the
whole fingerprints prune more.

What is broadcast is bounded: items are taken so many at a time that they have
``SHINGLES`` shingles together, each a pass over the texts. The index of over
``ITEMS`` items is not broadcast, but joined.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, small, written

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 fingerprints differ in about 10 of 64 bits (deviation 2.9).
RADIUS = 23
BLOCKS = 8
WIDTH = 64 // BLOCKS
#: Shingles of the items of a pass, and items whose index is broadcast.
SHINGLES = 1 << 19
ITEMS = 2000
#: Parts that the rows of a text are dealt into where they meet what is known of it.
PARTS = 16


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(hashed: Column, k: int) -> Column:
    """Hashes of all ``k`` words in a row, from the hashes of the words."""
    last = F.size(hashed) - k + 1
    each = F.transform(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(*[F.try_element_at(hashed, i + j) for j in range(k)])
    )
    return F.when(last >= 1, each).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """The SimHash of an array of hashes: bits set in over half of them. Two counts share a long."""
    lanes = F.lit(0x0000000100000001)

    def count(j: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, j).bitwiseAND(lanes))

    counts = F.array(*map(count, range(32)))
    total = F.size(hashes)
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda c: F.shiftrightunsigned(c, 32)
    one = F.lit(1).cast("long")
    return F.aggregate(
        F.transform(
            counts,
            lambda c, j: F.when(low(c) * 2 > total, F.call_function("shiftleft", one, j))
            .otherwise(0)
            .bitwiseOR(F.when(high(c) * 2 > total, F.call_function("shiftleft", one, j + 32)).otherwise(0)),
        ),
        F.lit(0).cast("long"),
        lambda a, b: a.bitwiseOR(b),
    )


def weighted_similarity(x: Column, y: Column) -> Column:
    """Sum of the least over sum of the greatest counts of two arrays."""
    plain = (F.size(F.array_distinct(x)) == F.size(x)) & (F.size(F.array_distinct(y)) == F.size(y))
    count = lambda a, h: F.size(F.filter(a, lambda v: v == h))
    both = F.when(plain, F.size(F.array_intersect(x, y))).otherwise(
        F.aggregate(F.array_intersect(x, y), F.lit(0), lambda a, h: a + F.least(count(x, h), count(y, h)))
    )
    return both / F.greatest(F.size(x) + F.size(y) - both, F.lit(1))


def _blocks(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, b * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int") for b in range(BLOCKS)]


def prepared(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, m, k, sh, fp, key)`` for items with words: size, words of a shingle, shingles, fingerprint, and a key of the row."""
    hashed = items.select(F.col(item_col).alias("item_id"), F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") > 0)
    sh = F.lit(None).cast("array<bigint>")
    for k in range(1, SHINGLE):
        sh = F.when(F.size("w") == k, shingles(F.col("w"), k)).otherwise(sh)
    sh = F.when(F.size("w") >= SHINGLE, shingles(F.col("w"), SHINGLE)).otherwise(sh)
    made = hashed.select("item_id", F.size("w").alias("m"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), sh.alias("sh"))
    return made.dropDuplicates(["item_id", "sh"]).withColumn("fp", simhash(F.col("sh"))).withColumn("key", F.xxhash64("item_id", "sh"))


# Arrays are exploded as outer ones: else Spark adds a filter on their size, and pushes it, with all that makes
# the array, below the projections that hold it ready.
def _windows(texts: DataFrame, items: DataFrame, k: int, sift: bool) -> DataFrame:
    """``(doc_id, m, win)``: shingles of the windows of sizes that items with shingles of ``k`` words have."""
    own = items.where(F.col("k") == k).select("key", "m", F.col("sh").alias("item_sh"))
    anchors = own.select("key", F.explode_outer(F.array_distinct("item_sh")).alias("h"))
    places = texts.select("doc_id", shingles(F.col("w"), k).alias("sh")).select("doc_id", "sh", F.posexplode_outer("sh").alias("p", "h"))
    count = F.col("m") - k + 1
    start = F.greatest(F.lit(0), F.least(F.col("p"), F.size("sh") - count))
    found = places.join(F.broadcast(anchors), "h").join(F.broadcast(own), "key")
    found = found.select("doc_id", "m", "item_sh", F.slice("sh", start + 1, count).alias("win"))
    if not sift:
        return found.select("doc_id", "m", "win")
    # overlap / (size + count - overlap) >= similarity; shingles that the item has not are outside the overlap
    least = F.ceil((F.size("win") + F.size("item_sh")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6)
    return found.where(F.size("win") - F.size(F.array_except("win", "item_sh")) >= least).select("doc_id", "m", "win")


def _pass(texts: DataFrame, items: DataFrame, ks: list[int], few: bool, sift: bool) -> DataFrame:
    """Links ``(doc_id, item_id, similarity)`` for items few enough to broadcast."""
    windows = None
    for k in ks:
        one = _windows(texts, items, k, sift)
        windows = one if windows is None else windows.unionByName(one)
    # a window that several items reach is one row
    windows = windows.dropDuplicates(["doc_id", "m", "win"])
    # kept as a table: conditions on fingerprints would else be pushed, with all that makes them, into the scan's join
    windows = checkpoint(windows.withColumn("fp", simhash(F.col("win"))))
    flips = [sum(1 << b for b in c) for e in range(RADIUS // BLOCKS + 1) for c in combinations(range(WIDTH), e)]
    keys = F.array(*[F.struct(F.lit(b).alias("block"), v.alias("value")) for b, v in enumerate(_blocks(F.col("fp")))])
    indexed = (
        items.select(F.col("key").alias("item"), "m", F.col("fp").alias("item_fp"), F.explode_outer(keys).alias("at"))
        .withColumn("flip", F.explode_outer(F.array(*map(F.lit, flips))))
        .select("item", "m", "item_fp", F.col("at.block").alias("block"), F.col("at.value").bitwiseXOR(F.col("flip")).alias("value"))
    )
    # windows with one fingerprint are looked up once
    prints = windows.select("m", "fp").distinct()
    probes = prints.select("m", "fp", F.posexplode_outer(F.array(*_blocks(F.col("fp")))).alias("block", "value"))
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    # a pair is taken at the first block that finds it, so it comes once
    near_block = lambda b: F.bit_count(F.shiftrightunsigned(apart, b * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))) <= RADIUS // BLOCKS
    first = F.lit(None).cast("int")
    for b in reversed(range(BLOCKS)):
        first = F.when(near_block(b), F.lit(b)).otherwise(first)
    near = probes.join(F.broadcast(indexed) if few else indexed, ["m", "block", "value"])
    near = small(written(near.where((F.bit_count(apart) <= RADIUS) & (F.col("block") == first)).select("m", "fp", "item")))
    found = windows.join(near, ["m", "fp"]).select("doc_id", "win", "item")
    own = items.select("item_id", "sh", F.col("key").alias("item"))
    return (
        found.join(F.broadcast(own), "item")
        .withColumn("similarity", weighted_similarity(F.col("win"), F.col("sh")))
        .where(F.col("similarity") >= SIMILARITY)
        .groupBy("doc_id", "item_id")
        .agg(F.max("similarity").alias("similarity"))
    )


def matches(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", sift: bool = True
) -> DataFrame:
    """``(doc_id, item_id, similarity)``: the items that texts hold, and the best similarity of a window.

    With ``sift`` windows that hold too few shingles of the item that they start
    with go before they are fingerprinted, some four of five; the result is the
    same.

    Words are lower-case runs of letters and digits; shingles have five, and an
    item of fewer words is one shingle. Windows lie inside the text; a text
    shorter than an item is one window. Null texts and texts or items without
    words match nothing. A number that several texts share stands for all of
    them; ``judge`` takes row for row. Other columns are ignored; empty tables give no rows.
    """
    known = checkpoint(prepared(items, item_col, item_text_col))
    sizes = known.groupBy("k").agg(F.count("*").alias("items"), F.sum(F.size("sh")).alias("shingles")).collect()  # five rows at most
    texts = docs.select(F.col(id_col).alias("doc_id"), F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("w"))
    ks = sorted(r["k"] for r in sizes) or [SHINGLE]
    passes = max(1, -(-sum(r["shingles"] for r in sizes) // SHINGLES))
    few = sum(r["items"] for r in sizes) <= ITEMS * passes
    out = None
    for number in range(passes):
        part = known if passes == 1 else known.where(F.pmod(F.col("key"), F.lit(passes)) == number)
        links = _pass(texts, part, ks, few, sift)
        out = links if out is None else out.unionByName(links)
    return out if passes == 1 else out.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def judge(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """One row for each row of ``docs``: doc_id, ``contaminated``, ``n_items``, ``item_ids`` (sorted) and ``similarity`` (best, else null).

    Each row is judged by its own text, whatever its id: rows may share an id or
    have none. 128 bits of a text stand for it, so equal texts fare alike.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("_of"), F.col(text_col).alias("text"))
    found = matches(named.select("_of", "text"), items, id_col="_of", sift=False, **columns).groupBy("doc_id").agg(
        F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.max("similarity").alias("similarity")
    )
    # rows of a text that very many have are dealt into parts, which each meet what is known of it
    hit = checkpoint(found.select(F.col("doc_id").alias("_of"), "item_ids", "similarity"))
    hit = hit.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    rows = named.select("doc_id", "_of", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("_part"))
    joined = rows.join(hit, ["_of", "_part"], "left")
    none = F.array().cast(dict(hit.dtypes)["item_ids"])
    return joined.select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
        "similarity",
    )
