"""Hard negatives for contrastive training, by a Voronoi-partitioned distributed kNN join.

Largest inner products are nearest neighbours once vectors are augmented: with
M the greatest norm, a row gets the coordinate sqrt(M² - |v|²), an anchor is
scaled to the norm M and gets 0. Then d² = 2 M² - 2 (M / |a|) a·v.

1. Pivots come from a bounded sample of rows; every row and every anchor
   belongs to the cell of its nearest pivot. Anchors of a cell are a group, in
   blocks of at most ``ANCHORS``.
2. The rows of an anchor's own cell are joined first. What they give bounds how
   far a better row can be.
3. A distance to a pivot can't differ from another's by more than the two are
   apart. So for each block and cell there is an interval of distances to the
   pivot that can serve an anchor of the block; only rows in it are sent there.
4. The rows sent to a block are dealt into chunks, so that no task gets all of a
   hot cell. A task holds the block's anchors and reads its rows as a stream; it
   keeps the best few of each anchor. These are merged over the chunks.

Positives are found so, then the negatives of each anchor and positive, whose
scores lie between two fractions of the positive's. Scores are whole numbers and
exact. In many dimensions the intervals spare little; whatever they spare, the
result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SMALL, scratch, written

#: Pivots, and rows of the sample that they come from for each.
PIVOTS, SAMPLE = 8, 16
#: Anchors of a block, rows of a chunk, and rows multiplied at a time.
ANCHORS, CHUNK, BLOCK = 1024, 2048, 2048
#: Parts of the labels, so that an anchor's positives are sought among few others, and parts of rows that meet many blocks.
LABEL_PARTS, SALT = 16, 64
#: Relative slack for rounding in distances; the scores themselves are exact.
SLACK = 1e-6
_LAST = (1 << 63) - 1
_BEST = "anchor long, slot int, id long, none boolean, score long"


def whole(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, label, q)`` with components floor(scale * x); rows without a label, or with a component that is no finite number, go."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    kept = vectors.where(F.col(label_col).isNotNull() & x.isNotNull() & finite)
    return kept.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("q"),
    )


def _matrix(q: pa.Array, dims: int) -> np.ndarray:
    """Vectors as doubles, shorter ones filled up with zeros."""
    sizes = np.diff(q.offsets.to_numpy())
    flat = q.flatten().to_numpy().astype(np.float64)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else []] = flat
    return out


class Space:
    """The augmented space: its dimensions, greatest norm, and pivots (with their last coordinate)."""

    def __init__(self, dims: int, norm: float, pivots: np.ndarray):
        self.dims, self.norm, self.pivots = dims, norm, pivots

    def rows(self, v: np.ndarray) -> np.ndarray:
        """Distances of rows to all pivots."""
        last = np.sqrt(np.maximum(self.norm**2 - (v * v).sum(axis=1), 0))
        return self._far(np.column_stack([v, last]))

    def anchors(self, a: np.ndarray) -> np.ndarray:
        """Distances of anchors to all pivots."""
        return self._far(np.column_stack([a * self.stretch(a)[:, None], np.zeros(len(a))]))

    def stretch(self, a: np.ndarray) -> np.ndarray:
        size = np.sqrt((a * a).sum(axis=1))
        return self.norm / np.where(size > 0, size, 1)

    def reach(self, a: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """How far from anchors ``a`` rows of these scores are; for an infinitely small score everything."""
        size = np.where((a * a).sum(axis=1) > 0, self.norm**2, 0.0)
        return np.sqrt(np.maximum(size + self.norm**2 - 2 * self.stretch(a) * scores, 0))

    def _far(self, x: np.ndarray) -> np.ndarray:
        d2 = (x * x).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1)[None, :] - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(d2, 0))


def _space(rows: DataFrame, pivots: int) -> Space:
    """Pivots are different rows of a sample of ``SAMPLE`` times as many, those of the smallest hashes."""
    least = rows.agg(
        F.max(F.size("q")).alias("dims"),
        F.max(F.aggregate("q", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))).alias("norm"),
    ).collect()[0]
    dims, norm = least["dims"] or 0, float(np.sqrt(least["norm"] or 0.0)) * (1 + 1e-9)
    # equal vectors have equal hashes: one of each
    sample = rows.groupBy(F.xxhash64("q").alias("h")).agg(F.first("q").alias("q")).orderBy("h").limit(pivots * SAMPLE)
    found = [np.pad(np.array(r["q"], float), (0, dims - len(r["q"]))) for r in sample.collect()]
    v = np.array(found).reshape(-1, dims) if found else np.zeros((1, dims))
    v = np.column_stack([v, np.sqrt(np.maximum(norm**2 - (v * v).sum(axis=1), 0))])
    # of the sample, each pivot is the row farthest from those taken before
    taken, far = [0], ((v - v[0]) ** 2).sum(axis=1)
    while len(taken) < min(pivots, len(v)):
        taken.append(int(np.argmax(far)))
        far = np.minimum(far, ((v - v[taken[-1]]) ** 2).sum(axis=1))
    return Space(dims, norm, v[taken])


def _placed(batches: Iterator[pa.RecordBatch], space: Space, anchors: bool) -> Iterator[pa.RecordBatch]:
    """The columns of a batch, with the cell and the distance to its pivot (rows) or to all pivots (anchors)."""
    for batch in batches:
        v = _matrix(batch.column("q"), space.dims)
        d = space.anchors(v) if anchors else space.rows(v)
        cell = d.argmin(axis=1)
        far = pa.array(list(d), pa.list_(pa.float64())) if anchors else pa.array(d[np.arange(len(d)), cell])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), far], names=[*batch.schema.names, "cell", "far"])


def _better(keep: int, anchor: np.ndarray, score: np.ndarray, none: np.ndarray, ident: np.ndarray) -> np.ndarray:
    """Places of the first ``keep`` of each anchor: highest score, then smallest id, null last."""
    order = np.lexsort((ident, none, -score, anchor))
    sorted_ = anchor[order]
    first = np.searchsorted(sorted_, sorted_)
    return order[np.arange(len(order)) - first < keep]


class _Block:
    """The best rows so far of each slot (an anchor, or an anchor with one of its positives)."""

    def __init__(self, keep: int):
        self.keep = keep
        self.slot, self.score, self.ident, self.none = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def start(self, count: int) -> None:
        self.floor = np.full(count, -_LAST, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray, none: np.ndarray) -> None:
        slot, score = np.concatenate([self.slot, slot]), np.concatenate([self.score, score])
        ident, none = np.concatenate([self.ident, ident]), np.concatenate([self.none, none])
        best = _better(self.keep, slot, score, none, ident)
        self.slot, self.score, self.ident, self.none = slot[best], score[best], ident[best], none[best]
        # a slot that is full takes nothing below its last
        full = np.bincount(self.slot, minlength=len(self.floor)) >= self.keep
        worst = np.full(len(self.floor), _LAST, np.int64)
        np.minimum.at(worst, self.slot, self.score)
        self.floor = np.where(full, worst, self.floor)


def _exact(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products; in doubles where these are exact, else in whole numbers of any size."""
    if a.size and v.size and np.abs(a).max() * np.abs(v).max() * a.shape[1] < 2**53:
        return (a @ v.T).astype(np.int64)
    return np.array([[sum(int(x) * int(y) for x, y in zip(p, q)) for q in v] for p in a], object).reshape(len(a), len(v)).astype(np.int64)


def _joined(batches: Iterator[pa.RecordBatch], dims: int, keep: int, same: bool) -> Iterator[pa.RecordBatch]:
    """``_BEST`` of sorted rows: those of a block and chunk stand together, anchors (kind 0) first.

    ``same``: rows of the anchor's label, else of others; with a score between the ``low`` and ``high`` of each slot.
    """
    block = anchors = None
    key = None
    names = ["kind", "block", "chunk", "anchor", "id", "label", "q", "low", "high"]

    def result() -> Iterator[pa.RecordBatch]:
        if block is not None and len(block.slot):
            number, slot = anchors["key"][block.slot // anchors["slots"]], block.slot % anchors["slots"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(number), pa.array(slot.astype(np.int32)), pa.array(block.ident), pa.array(block.none), pa.array(block.score)],
                names=["anchor", "slot", "id", "none", "score"],
            )

    held: list[pa.RecordBatch] = []

    def begin() -> None:
        nonlocal block, anchors
        t = pa.Table.from_batches(held).combine_chunks()
        ident = t["id"].fill_null(_LAST).to_numpy()
        low, high = (t[c].to_pylist() for c in ("low", "high"))
        slots = max([1, *(len(x or ()) for x in low)])
        # a slot that isn't there takes nothing
        fill = lambda x, none: np.array([[*(r or ()), *[none] * (slots - len(r or ()))] for r in x], np.int64)
        anchors = {"key": t["anchor"].to_numpy(), "id": ident, "label": t["label"].to_numpy(), "v": _matrix(t["q"].combine_chunks(), dims), "slots": slots}
        anchors |= {"low": fill(low, _LAST), "high": fill(high, -_LAST)}
        block = _Block(keep)
        block.start(len(ident) * slots)

    def feed(part: pa.RecordBatch) -> None:
        part = part.sort_by("id")  # nulls last
        ident = part.column("id")
        none = ident.is_null().to_numpy(zero_copy_only=False)
        ident = ident.fill_null(_LAST).to_numpy()
        label = part.column("label").to_numpy()
        score = _exact(anchors["v"], _matrix(part.column("q"), dims))
        equal = anchors["label"][:, None] == label[None, :]
        itself = (anchors["id"][:, None] == ident[None, :]) & ~none[None, :]
        fit = (equal if same else ~equal) & ~itself
        slots = anchors["slots"]
        for k in range(slots):
            at = np.arange(len(score)) * slots + k
            ok = fit & (score >= np.maximum(block.floor[at], anchors["low"][:, k])[:, None]) & (score <= anchors["high"][:, k][:, None])
            if ok.shape[1] > keep:  # the first few of each alone; rows are in the order of ids
                value = np.where(ok, score, -_LAST)
                worst = np.partition(value, -keep, axis=1)[:, -keep][:, None]
                tie = ok & (score == worst)
                ok = (ok & (score > worst)) | (tie & (np.cumsum(tie, axis=1) <= keep))
            a, r = np.nonzero(ok)
            if len(a):
                block.add(at[a], score[a, r], ident[r], none[r])

    for batch in batches:
        kind, b, c = (batch.column(k).to_numpy() for k in names[:3])
        cuts = np.flatnonzero((np.diff(kind) != 0) | (np.diff(b) != 0) | (np.diff(c) != 0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kind)]):
            if lo == hi:
                continue
            part, now = batch.slice(lo, hi - lo), (int(b[lo]), int(c[lo]))
            if now != key:
                yield from result()
                key, block, held = now, None, []
            if kind[lo] == 0:
                held.append(part)
                continue
            if block is None and held:
                begin()
                held = []
            if block is not None:
                for x in range(0, part.num_rows, BLOCK):
                    feed(part.slice(x, BLOCK))
    yield from result()


def _merged(best: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` rows of each slot over all chunks, of which each gives ``keep`` at most."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "none", "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _dealt(anchors: DataFrame, label_parts: int) -> DataFrame:
    """``anchors`` with the block of each: those of a cell (and part of the labels), dealt into parts of about ``ANCHORS``."""
    own = anchors.withColumn("lp", F.pmod(F.xxhash64("label"), F.lit(label_parts)).cast("int"))
    parts = own.groupBy("cell", "lp").agg(F.ceil(F.count("*") / ANCHORS).alias("parts"))
    part = F.pmod(F.xxhash64("anchor"), F.col("parts"))
    block = F.shiftleft(F.col("cell").cast("long"), 44) + F.shiftleft(F.col("lp").cast("long"), 36) + part
    return own.join(F.broadcast(parts), ["cell", "lp"]).withColumn("block", block).drop("parts")  # a row for each cell and part


def _join(anchors: DataFrame, rows: DataFrame, reach: DataFrame, space: Space, keep: int, same: bool) -> DataFrame:
    """``_BEST`` of the rows that ``reach(block, lp, cell, least, most)`` sends to each block."""
    dims = space.dims
    parts = F.broadcast(rows.groupBy("cell", "lp").agg(F.ceil(F.count("*") / CHUNK).alias("parts")))
    reach = written(reach.join(parts, ["cell", "lp"]))
    chunk = lambda part: F.shiftleft(F.col("cell").cast("long"), 40) + part
    nothing = F.lit(None).cast("array<long>")
    if reach.count() <= SMALL:
        met = rows.join(F.broadcast(reach), ["cell", "lp"])
    else:  # few keys, many rows on both sides: the rows are dealt out, and each part of them meets all that reach its cell
        salted = reach.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("q", "id"), F.lit(SALT)).cast("int")).join(salted, ["cell", "lp", "salt"])
    part = F.pmod(F.xxhash64("id", "q"), F.col("parts"))
    sent = met.where("far between least and most").select(
        F.lit(1).alias("kind"), "block", chunk(part).alias("chunk"), F.lit(0).cast("long").alias("anchor"), "id", "label", "q", nothing.alias("low"), nothing.alias("high")
    )
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    asked = anchors.join(reach.select("block", F.col("cell").alias("to"), each.alias("part")), "block")
    asked = asked.withColumn("cell", F.col("to"))
    asked = asked.select(F.lit(0).alias("kind"), "block", chunk(F.col("part")).alias("chunk"), "anchor", "id", "label", "q", "low", "high")
    dealt = asked.unionByName(sent).repartition("block", "chunk").sortWithinPartitions("block", "chunk", "kind")
    return dealt.mapInArrow(lambda b: _joined(b, dims, keep, same), _BEST)


def _intervals(batches: Iterator[pa.RecordBatch], space: Space) -> Iterator[pa.RecordBatch]:
    """``(block, lp, cell, least, most)`` for each anchor and other cell, from ``(block, lp, cell, q, far, low, high, floors)``."""
    for batch in batches:
        block, lp, home = (batch.column(k).to_numpy() for k in range(3))
        a = _matrix(batch.column(3), space.dims)
        far = np.array(batch.column(4).to_pylist(), float).reshape(len(a), -1)
        least, most = np.full(far.shape, np.inf), np.full(far.shape, -np.inf)
        slack = SLACK * max(space.norm, 1)
        lows, highs, floors = (batch.column(k).to_pylist() for k in (5, 6, 7))
        for slot in range(max(map(len, lows), default=0)):
            has = np.array([slot < len(x) and x[slot] <= y[slot] for x, y in zip(lows, highs)])
            pick = lambda x: np.array([float(r[slot]) if h else 0.0 for r, h in zip(x, has)])  # noqa: B023, E731
            low, high = pick(lows), pick(highs)
            low = np.maximum(low, np.array([f.get(slot, -np.inf) for f in map(dict, floors)]))  # what is found already
            outer = np.where(low > -_LAST / 2, space.reach(a, np.maximum(low, -_LAST / 2)), np.inf)[:, None] + slack
            inner = np.where(high < _LAST / 2, space.reach(a, np.minimum(high, _LAST / 2)), 0.0)[:, None] - slack
            least = np.where(has[:, None], np.minimum(least, np.maximum(far - outer, inner - far)), least)
            most = np.where(has[:, None], np.maximum(most, far + outer), most)
        i, j = np.nonzero((np.arange(far.shape[1])[None, :] != home[:, None]) & (least <= most))
        yield pa.RecordBatch.from_arrays(
            [pa.array(block[i]), pa.array(lp[i]), pa.array(j.astype(np.int32)), pa.array(least[i, j]), pa.array(most[i, j])],
            names=["block", "lp", "cell", "least", "most"],
        )


def _nearest(anchors: DataFrame, rows: DataFrame, space: Space, keep: int, same: bool) -> DataFrame:
    """``(anchor, slot, id, none, score, rank)``: the first ``keep`` rows of each slot."""
    label_parts = LABEL_PARTS if same else 1
    anchors = written(_dealt(anchors, label_parts))
    rows = rows.withColumn("lp", F.pmod(F.xxhash64("label"), F.lit(label_parts)).cast("int"))
    own = anchors.select("block", "lp", "cell").distinct()
    own = own.select("block", "lp", "cell", F.lit(float("-inf")).alias("least"), F.lit(float("inf")).alias("most"))
    first = written(_merged(_join(anchors, rows, own, space, keep, same), keep))
    last = first.where(F.col("rank") == keep).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("floors"))
    none = F.create_map().cast("map<int,bigint>")
    known = anchors.join(last, "anchor", "left").select("block", "lp", "cell", "q", "far", "low", "high", F.coalesce("floors", none).alias("floors"))
    each = known.mapInArrow(lambda b: _intervals(b, space), "block long, lp int, cell int, least double, most double")
    reach = each.groupBy("block", "lp", "cell").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    more = _join(anchors, rows, reach, space, keep, same)
    return written(_merged(first.drop("rank").unionByName(more), keep))


def mine(
    vectors: DataFrame,
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    pivots: int = PIVOTS,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows whose id is divisible by ``every``; their positives the
    first ``positives`` other rows of their label. Of each anchor and positive,
    the first ``negatives`` rows of other labels are returned whose score is
    ``low`` to ``high`` hundredths of the positive's. A score is the inner
    product of components floor(``scale`` * x); higher ones come first, then
    smaller ids, a null id last.

    Rows with a null label or vector, or a component that is null or not
    finite, take no part. Vectors of different lengths are filled up with
    zeros. Rows with an anchor's id are never its positives or negatives; rows
    repeated elsewhere count each. An anchor repeated with the same label and
    vector is one anchor. Other columns are ignored; empty tables give no rows.
    A score that doesn't fit into 64 bits is an error.
    """
    spark = vectors.sparkSession
    with scratch(spark) as keep_all:
        rows = written(whole(vectors, id_col, label_col, vector_col, scale))
        space = _space(rows, pivots)
        placed = "id long, label long, q array<long>, cell int, far "
        chosen = rows.where(F.col("id") % every == 0).distinct()
        chosen = written(chosen.mapInArrow(lambda b: _placed(b, space, True), placed + "array<double>").withColumn("anchor", F.xxhash64("id", "label", "q")))
        rows = written(rows.mapInArrow(lambda b: _placed(b, space, False), placed + "double"))
        span = lambda x: F.array(F.lit(x).cast("long"))
        found = _nearest(chosen.withColumn("low", span(-_LAST)).withColumn("high", span(_LAST)), rows, space, positives, same=True)
        found = found.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive"), F.col("none").alias("no_positive"), F.col("score").alias("positive_score"))
        found = written(found)
        down = lambda x: F.expr(f"cast(({x} - pmod({x}, 100L)) div 100 as long)")
        bounds = found.select("anchor", "slot", (-down(f"(-{low}L * positive_score)")).alias("low"), down(f"({high}L * positive_score)").alias("high"))
        slots = bounds.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "low", "high"))).alias("s"))
        asking = chosen.join(slots, "anchor").withColumn("low", F.col("s.low")).withColumn("high", F.col("s.high")).drop("s")
        worst = _nearest(asking, rows, space, negatives, same=False)
        out = worst.join(found, ["anchor", "slot"]).join(chosen.select("anchor", F.col("id").alias("anchor_id")), "anchor")
        without = lambda x, none: F.when(~F.col(none), F.col(x))
        return keep_all(
            out.select(
                "anchor_id",
                without("positive", "no_positive").alias("positive_id"),
                F.col("rank").cast("int").alias("rank"),
                without("id", "none").alias("negative_id"),
                "positive_score",
                F.col("score").alias("negative_score"),
            )
        )
