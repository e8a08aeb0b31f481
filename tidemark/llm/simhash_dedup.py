"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are collapsed first, so copies cost one row. The 64 bits are dealt
into partitions so that correlated bits share one, and a dynamic program gives
the partitions unequal thresholds whose sum is ``radius - parts + 1``, at the
least estimated number of candidates: two fingerprints within ``radius`` agree,
within its threshold, on one partition at least. A partition is probed with all
values within its threshold (-1: not at all), candidates of a bucket are
verified, and a bucket returns a spanning forest, never its pairs.

Buckets over ``WIDE`` members take an exact way. For a radius of 2 it needs no
pairs: every member is dealt to its own value and its 64 neighbours. Fingerprints
within 2 bits meet at a value next to both, all that meet are within 2 bits, and
at most 65 different ones can meet. For a greater radius such a bucket is dealt
into blocks of ``WIDE`` members, and each two blocks are a task's work.

``similar_groups`` is for the similarity of shingle sets: fingerprints within
``radius`` are its first candidates, verified by the sets; what the radius misses
(at a similarity of 0.8 about ten bits of 64 differ, and so wide a radius chooses
nothing) is found by the exact prefix filter of ``shingle_sets``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shingle_sets
from tidemark.llm.common import BLOCK, HOT, checkpoint, components, scratch, shingle_hashes, small, small_batches, split_join, written

BITS = 64
WIDE = 256


def fingerprint(raw: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text, unsigned; 0 if it has no words.

    Bit i is set if over half the XXH64 values of its word shingles (repeats
    included) have it. Fewer words than ``shingle`` make one shingle.
    """
    return shingle_sets.majority(shingle_hashes(raw, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for each row; fp is the fingerprint as a signed long. A null text has no words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(raw or b"", shingle) for raw in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j set, over all of them.

    Each task sends one 64 x 64 matrix, whatever it has read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            for at in range(0, len(raw), BLOCK):
                bits = np.unpackbits(raw[at : at + BLOCK], axis=1, bitorder="little").astype(np.float32)
                both += np.rint(bits.T @ bits).astype(np.int64)
            n += len(raw)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS + 1), pa.int32()), pa.array([*both.ravel().tolist(), n], pa.int64())], names=["i", "v"])

    sums = fps.select("fp").mapInArrow(run, "i int, v long").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for row in sums:
        flat[row["i"]] = row["v"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` partitions of near equal size, each with bits that go together.

    Greedy: a partition starts from the free bit with the strongest ties and
    takes the bit most correlated with those it has.
    """
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        own = [max(free, key=lambda i: (tie[i, free].sum(), -i))]
        free.remove(own[0])
        while len(own) < size:
            own.append(max(free, key=lambda i: (tie[i, own].sum(), -i)))
            free.remove(own[-1])
        out.append(sorted(own))
    return out


def _variants(width: int, threshold: int) -> int:
    total, term = 0, 1
    for e in range(threshold + 1):
        total += term
        term = term * (width - e) // (e + 1)
    return total


def allocate(n: int, both: np.ndarray, parts: list[list[int]], radius: int) -> tuple[float, list[int]]:
    """Thresholds (-1 to radius) of the partitions by dynamic programming, and their cost.

    The cost of a threshold: rows dealt out, plus candidates estimated from how
    often two fingerprints agree on each bit.
    """
    p = np.diag(both) / max(n, 1)
    agree = np.clip(p**2 + (1 - p) ** 2, 0.5, 1 - 1e-9)

    def cost(part: list[int], e: int) -> float:
        if e < 0:
            return 0.0
        near = np.zeros(2 * e + 1)  # odds of just so many bits apart; two values that share a variant are within 2e
        near[0] = 1
        for q in agree[part]:
            near[1:] = near[1:] * q + near[:-1] * (1 - q)
            near[0] *= q
        rows = n * _variants(len(part), e)
        return rows + n * n / 2 * float(near.sum())

    goal = radius - len(parts) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in parts:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (spent, chosen) in best.items():
            for e in range(-1, radius + 1):
                option = (spent + cost(part, e), [*chosen, e])
                if used + e not in nxt or option < nxt[used + e]:
                    nxt[used + e] = option
        best = nxt
    return best[goal]


def plan(n: int, both: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """Partitions and their thresholds, over the number of partitions that costs least."""
    options = []
    for m in range(1, radius + 3):
        parts = group_bits(n, both, m)
        cost, thresholds = allocate(n, both, parts, radius)
        options.append((cost, m, list(zip(parts, thresholds))))
    return [(part, e) for part, e in min(options)[2] if e >= 0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(bits: tuple[int, ...] | list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def _keys(fp: Column, part: int, bits: list[int], threshold: int) -> Column:
    """Structs of the partition's number and every value within ``threshold`` of the fingerprint's."""
    value = fp.bitwiseAND(F.lit(_mask(bits)))
    flips = [_mask(c) for e in range(threshold + 1) for c in combinations(bits, e)]
    return F.transform(
        F.array(*[F.lit(f).cast("long") for f in flips]),
        lambda f: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(f).alias("value")),
    )


def _forest(groups: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in groups:
        left, right = [], []
        for members in batch.column(0).to_pylist():
            fp = np.array(members, np.int64).view(np.uint64)
            near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
            np.fill_diagonal(near, False)
            if not near.any():
                continue
            free = near.any(axis=1)
            while free.any():
                front = [int(np.argmax(free))]
                free[front[0]] = False
                while front:
                    i = front.pop()
                    new = np.flatnonzero(near[i] & free)
                    free[new] = False
                    left += [members[i]] * len(new)
                    right += [members[j] for j in new]
                    front += new.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _star(fps: DataFrame) -> DataFrame:
    """Links of all fingerprints within 2 bits, without buckets of pairs (see above)."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_mask([b])).cast("long") for b in range(BITS)])
    met = (
        fps.select("fp", F.explode(flips).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
        .groupBy("key")
        .agg(F.collect_set("fp").alias("members"))  # 65 at most
        .where(F.size("members") > 1)
        .select(F.array_sort("members").alias("members"))
    )
    return met.select(F.col("members")[0].alias("a"), F.explode(F.slice("members", 2, BITS + 1)).alias("b")).distinct()


def links(fps: DataFrame, radius: int = 2, wide: int = WIDE) -> DataFrame:
    """Links ``(a, b)`` that connect all different fingerprints ``fp`` within ``radius`` bits.

    The links are a spanning subset: their components are those of all pairs
    within the radius. ``radius`` is 0 to 16; the wider, the less it prunes.
    """
    if not 0 <= radius <= 16:
        raise ValueError("radius must be 0 to 16")
    n, both = bit_counts(fps)
    keyed = None
    for k, (bits, e) in enumerate(plan(n, both, radius)):
        one = fps.select("fp", F.explode(_keys(F.col("fp"), k, bits, e)).alias("key"))
        keyed = one if keyed is None else keyed.unionByName(one)
    keyed = keyed.select("fp", "key.part", "key.value")
    crowded = keyed.groupBy("part", "value").count().where(F.col("count") > wide).select("part", "value")
    crowded = checkpoint(crowded)
    groups = (
        keyed.join(crowded, ["part", "value"], "left_anti")
        .groupBy("part", "value")
        .agg(F.collect_set("fp").alias("members"))
        .where(F.size("members") > 1)
        .select(F.array_sort("members").alias("members"))
    )
    out = groups.mapInArrow(lambda b: _forest(b, radius), "a long, b long").distinct()
    if not crowded.limit(1).count():
        return out
    if radius > 2:
        return out.union(_blocks(keyed, crowded, radius, wide)).distinct()
    heavy = keyed.join(crowded, ["part", "value"], "left_semi").select("fp").distinct()
    star = _star(heavy) if radius == 2 else _near(heavy, radius)
    return out.union(star).distinct()


def _blocks(keyed: DataFrame, crowded: DataFrame, radius: int, wide: int) -> DataFrame:
    """Links inside crowded buckets: members are dealt into blocks, and a task gets two blocks at a time."""
    sizes = keyed.join(crowded, ["part", "value"], "left_semi").groupBy("part", "value").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / wide).cast("int")
    dealt = keyed.join(sizes, ["part", "value"]).select("fp", "part", "value", blocks.alias("blocks"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.groupBy("part", "value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    members = pairs.agg(F.array_sort(F.collect_set("fp")).alias("members")).where(F.size("members") > 1).select("members")
    return members.mapInArrow(lambda b: _forest(b, radius), "a long, b long")


def _near(fps: DataFrame, radius: int) -> DataFrame:
    """Links within one bit: neighbours that are there, at most 64 for each."""
    if radius == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    flips = F.array(*[F.lit(_mask([b])).cast("long") for b in range(BITS)])
    near = fps.select(F.col("fp").alias("a"), F.explode(flips).alias("flip")).select("a", F.col("a").bitwiseXOR(F.col("flip")).alias("b"))
    return near.where("a < b").join(fps.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs``.

    component_id is the smallest id reachable over links of ``radius`` bits or
    fewer. Texts that are null or without words have fingerprint 0 and link to
    each other like any other. Repeated rows stay; a null id never becomes a
    component's id unless it has no other. Empty tables give no rows.
    """
    found = checkpoint(fingerprints(docs, shingle, id_col, text_col))
    distinct = checkpoint(found.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first_id", "n", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = checkpoint(rooted.join(smallest, "root").select("fp", "component_id", "n"))
    # copies, and texts without words, share a fingerprint: their rows don't meet in one task
    rows = named.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
    return split_join(found, named, ["fp"], F.col("n") > rows / HOT).select("doc_id", "fp", "component_id")


def similar_groups(docs: DataFrame, id_col: str, text_col: str = "text", radius: int = 3, shingle: int = shingle_sets.SHINGLE) -> DataFrame:
    """``(id, group)``, a row for each different id: texts with one id must be equal.

    Groups are the components of all pairs of texts whose sets of word shingles
    have a similarity of 0.8 or more. Texts that are null or without words are
    one group, repeated rows are one id; empty tables give no rows.
    """
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        found = written(shingle_sets.sets(texts, shingle, shingle_sets.TENTHS))
        names = written(found.groupBy("id").agg(F.min("node").alias("node")))
        one = written(found.groupBy("node").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("fp").alias("fp")))
        # only sets that can be similar to another one go on, one text for each
        left = shingle_sets.with_company(found, one)
        some = texts.join(small(left.select("id")), "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
        full = written(shingle_sets.sets(some, shingle).select("node", "n", "sh"))
        # texts of one fingerprint, and of linked ones
        firsts = checkpoint(one.where("n > 0").groupBy("fp").agg(F.min("node").alias("first")))
        near = links(firsts.select("fp"), radius)
        a, b = (firsts.select(F.col("fp").alias(x), F.col("first").alias(y)) for x, y in (("a", "x"), ("b", "y")))
        told = one.join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
        told = told.unionByName(near.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
        held = shingle_sets.prefixes(full)
        places = shingle_sets.meeting_places(held)
        linked = shingle_sets.similar(told.unionByName(shingle_sets.star(held, places)), full)
        roots = components(linked)
        more = written(shingle_sets.across(held, places, roots))
        if more.limit(1).count():
            more = shingle_sets.similar(more, full)
            roots = components(linked.unionByName(more)) if more.limit(1).count() else roots
        return keep(names.join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("group")))
