"""Exact removal of long repeated byte strings with a sparse, distributed suffix sort.

A string of ``length`` bytes is removed wherever it starts if it also starts
somewhere else. Sorting a suffix for every byte would move hundreds of times
the corpus, so suffixes are sampled by content: each window of ``length`` bytes
is anchored at one gram (``gram`` bytes, the leading bytes of the suffix there)
inside it, that of the least hash among the least common ones. Equal windows
have equal grams at equal distances, so nothing is lost. Consecutive windows
with one anchor form a run. How common a gram is comes from counts over all
texts (``Sketch``), so the windows about a passage that many texts share are
anchored outside of it where they can be, and a common gram has few different
runs; any counts give the same result.

1. Each task finds the runs of its texts. A run moves as two hashes and a place:
   the hash of its gram, and that of all bytes under its windows.
2. A gram that occurs once rules its run out. Of runs with equal bytes one stands
   for all with their number, counted before the shuffle.
3. Those that stand for others move with their bytes. Sampled splitters over the
   leading bytes of the suffixes deal them into ranges (``repartitionByRange``),
   and each bucket sorts the parts right and left of the anchors by multikey
   quicksort. Windows are equal if both parts share a long enough prefix, read
   off the common prefixes of neighbours; a run that stands for several is
   repeated as a whole.
4. The first and the last gram of a bucket may go on in the buckets beside it:
   their suffixes are compared across the boundaries.
5. A gram with over ``GROUP`` different runs takes another exact way: each window
   is a row, counted by its hash, so that no task holds the group.
6. What was found for a run goes back to all runs with its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import CELL_BITS, HOT, Sketch, scratch, small_batches, split_join, written

GRAM = 48
#: Window starts handled at a time; offsets of a segment fit into the low 20 bits.
SEGMENT = 1 << 19
LOW = np.uint64((1 << 20) - 1)
GROUP = 4_000
#: Cells (windows x runs) compared at a time.
CELLS = 500_000
SMALL = 24
_MIX = np.uint64(0x9E3779B97F4A7C15)


_MADE: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, powers of an odd base, and their inverses, modulo 2**64."""
    if _MADE:
        return _MADE[0]
    byte = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)
    base = 0x5851F42D4C957F2D
    size = SEGMENT + 4096

    def powers(x: int) -> np.ndarray:
        out = np.full(size, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    _MADE.append((byte, powers(base), powers(pow(base, -1, 1 << 64))))
    return _MADE[0]


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    byte, power, inverse = _tables()
    if len(data) > len(power):
        raise ValueError("segment too long")
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(byte[data] * power[: len(data)], out=sums[1:])
    h = sums[gram:] - sums[:-gram]
    h *= inverse[: len(h)]
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h


def anchors(raw: bytes, length: int, gram: int, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows as (first start, last start, anchor). ``levels`` (4 bits) say which grams are common."""
    windows = len(raw) - length + 1
    found = []
    for at in range(0, max(windows, 0), SEGMENT):
        count = min(SEGMENT, windows - at)
        h = _gram_hashes(np.frombuffer(raw, np.uint8, count + length - 1, at), gram)
        if levels is not None:
            level = levels[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64)
            h = (h * _MIX >> np.uint64(4)) | (level << np.uint64(60))
        wide = length - gram + 1
        padded = np.full(-(-len(h) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(h)] = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
        block = padded.reshape(-1, wide)
        ahead = np.minimum.accumulate(block, axis=1).ravel()
        behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:count], ahead[wide - 1 : wide - 1 + count])
        anchor = (least & LOW).astype(np.int64)
        new = np.flatnonzero(np.diff(anchor)) + 1
        first = np.concatenate(([0], new))
        last = np.concatenate((new - 1, [count - 1]))
        found.append((first + at, last + at, anchor[first] + at))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


RUNS = "doc_id long, th long, place long, kh long, sh long"
#: A place is the anchor, its distance from the first window's start, and from the last one's, twelve bits each.
SPOT = 12
_FIELD = (1 << SPOT) - 1


def _gram_levels(texts: DataFrame, gram: int) -> np.ndarray:
    """How common grams are in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch()
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                for at in range(0, len(raw or b"") - gram + 1, SEGMENT):
                    sketch.add(_gram_hashes(np.frombuffer(raw, np.uint8, min(SEGMENT + gram - 1, len(raw) - at), at), gram))
        yield sketch.batch()

    return Sketch.levels(texts.select("raw").mapInArrow(run, Sketch.SCHEMA))


def _runs(batches: Iterator[pa.RecordBatch], length: int, gram: int, levels: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    import xxhash

    gram_hash, run_hash = xxhash.xxh64_intdigest, xxhash.xxh3_64_intdigest
    for batch in batches:
        ids, hashes, texts = (batch.column(i).to_pylist() for i in range(3))
        places: list[np.ndarray] = []
        owner: list[tuple[int, int]] = []
        kh, sh = [], []
        for i, th, raw in zip(ids, hashes, texts):
            if raw is None or len(raw) < length:
                continue
            lo, hi, a = anchors(raw, length, gram, levels)
            kh += [gram_hash(raw[x : x + gram]) for x in a.tolist()]
            sh += [run_hash(raw[x : y + length], z) for x, y, z in zip(lo.tolist(), hi.tolist(), (a - lo).tolist())]
            places.append(a << (2 * SPOT) | (a - lo) << SPOT | (a - hi))
            owner.append((i, th))
        if not owner:
            continue
        index = pa.array(np.repeat(np.arange(len(owner)), [len(x) for x in places]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in owner], pa.int64()).take(index),
                pa.array([x[1] for x in owner], pa.int64()).take(index),
                pa.array(np.concatenate(places)),
                pa.array(np.array(kh, np.uint64).view(np.int64)),
                pa.array(np.array(sh, np.uint64).view(np.int64)),
            ],
            names=["doc_id", "th", "place", "kh", "sh"],
        )


def multikey_quicksort(strings: list[bytes], char: int = 8) -> list[int]:
    """Order of ``strings``: ternary partitions by characters of ``char`` bytes, small ones sorted at once."""
    order, stack = list(range(len(strings))), [(0, len(strings), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        part = order[lo:hi]
        if len(part) <= SMALL:
            order[lo:hi] = sorted(part, key=lambda i: strings[i][depth:])
            continue
        key = {i: strings[i][depth : depth + char] for i in part}
        pivot = sorted((key[part[0]], key[part[len(part) // 2]], key[part[-1]]))[1]
        less = [i for i in part if key[i] < pivot]
        same = [i for i in part if key[i] == pivot]
        more = [i for i in part if key[i] > pivot]
        order[lo:hi] = less + same + more
        stack.append((lo, lo + len(less), depth))
        stack.append((hi - len(more), hi, depth))
        if len(pivot) == char:  # else the strings have ended and are equal
            stack.append((lo + len(less), hi - len(more), depth + char))
    return order


def _common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    return int(np.argmax(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)))


def _classes(strings: list[bytes], needs: np.ndarray) -> np.ndarray:
    """For each needed length a class of each string: equal if that much of their starts is."""
    order = np.array(multikey_quicksort(strings))
    shared = np.array([_common(strings[order[k]], strings[order[k - 1]]) for k in range(1, len(order))])
    out = np.zeros((len(needs), len(strings)), np.int64)
    out[:, order[1:]] = np.cumsum(shared[None, :] < needs[:, None], axis=1)
    return out


def repeated_windows(runs: list[tuple[int, int, bytes]], length: int) -> Iterator[tuple[int, np.ndarray]]:
    """For runs at one gram as (first, last window start relative to the anchor, bytes): repeated starts of each."""
    first = np.array([x[0] for x in runs])
    last = np.array([x[1] for x in runs])
    right = [x[2][-x[0] :] if x[0] else x[2] for x in runs]
    left = [x[2][: -x[0]][::-1] if x[0] else b"" for x in runs]
    hits: list[list[np.ndarray]] = [[] for _ in runs]
    step = max(1, CELLS // len(runs))
    for at in range(int(first.min()), int(last.max()) + 1, step):
        starts = np.arange(at, min(at + step, int(last.max()) + 1))
        cells = _classes(right, length + starts) * len(runs) + _classes(left, -starts)
        has = (first[None, :] <= starts[:, None]) & (starts[:, None] <= last[None, :])
        cells = np.where(has, cells, -1 - np.arange(len(runs))[None, :])
        order = np.argsort(cells, axis=1, kind="stable")
        ranked = np.take_along_axis(cells, order, axis=1)
        same = ranked[:, 1:] == ranked[:, :-1]
        twice = np.zeros(cells.shape, bool)
        twice[:, 1:] |= same
        twice[:, :-1] |= same
        hit = np.zeros(cells.shape, bool)
        np.put_along_axis(hit, order, twice, axis=1)
        for run in np.flatnonzero(hit.any(axis=0)):
            hits[run].append(starts[hit[:, run]])
    for run, found in enumerate(hits):
        if found:
            yield run, np.concatenate(found)


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Sorted window starts as intervals of bytes, one for each row of consecutive starts."""
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    return [(int(x[0]), int(x[-1]) + length) for x in np.split(starts, cut)]


#: Spans are relative to the anchor; a row without spans is one whose gram goes on beyond its bucket.
FOUND = "kh long, sh long, n long, spans array<struct<start:long,stop:long>>, g binary, before long, bytes binary, after long"
_PAIRS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _found_batch(rows: list[dict]) -> pa.RecordBatch:
    types = {"kh": pa.int64(), "sh": pa.int64(), "n": pa.int64(), "spans": _PAIRS, "g": pa.binary(), "before": pa.int64(), "bytes": pa.binary(), "after": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in types.items()], names=list(types))


def _judged(group: list[dict], length: int) -> Iterator[dict]:
    """The runs of one gram, compared with each other."""
    hits: dict[int, list[tuple[int, int]]] = {}
    if len(group) > 1:
        runs = [(-r["before"], -r["after"], r["bytes"]) for r in group]
        hits = {k: _spans(starts, length) for k, starts in repeated_windows(runs, length)}
    for k, r in enumerate(group):
        spans = [(-r["before"], length - r["after"])] if r["n"] > 1 else hits.get(k)
        if spans:
            yield {"kh": r["kh"], "sh": r["sh"], "spans": [{"start": x, "stop": y} for x, y in spans]}


def _sorted_buckets(batches: Iterator[pa.RecordBatch], length: int, open_ends: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram. With ``open_ends`` the first and the last gram's rows are given back as they are."""
    group: list[dict] = []
    out: list[dict] = []
    first = open_ends
    for batch in batches:
        for row in batch.to_pylist():
            if group and group[-1]["g"] != row["g"]:
                out.extend(group if first else _judged(group, length))
                first = False
                group = []
            group.append(row)
        if out:
            yield _found_batch(out)
            out = []
    out.extend(group if open_ends else _judged(group, length))
    yield _found_batch(out)


def _cut_runs(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Texts with the runs wanted from them, as a row for each run and its bytes."""
    for batch in batches:
        rows = []
        for raw, wanted in zip(*(batch.column(k).to_pylist() for k in range(2))):
            for r in wanted:
                a, before, after = r["place"] >> (2 * SPOT), r["place"] >> SPOT & _FIELD, r["place"] & _FIELD
                data = {"bytes": raw[a - before : a - after + length], "g": raw[a : a + gram]}
                rows.append({"kh": r["kh"], "sh": r["sh"], "n": r["n"], "before": before, "after": after, **data})
        yield _found_batch(rows)


def _window_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """A row for each window of a run: its hash, distance from the anchor, and the run."""
    import xxhash

    for batch in batches:
        for row in batch.select(["bytes", "before", "kh", "sh", "n"]).to_pylist():
            raw, count = row["bytes"], len(row["bytes"]) - length + 1
            w = np.array([xxhash.xxh3_64_intdigest(raw[k : k + length]) for k in range(count)], np.uint64)
            same = [pa.array(np.full(count, row[k], np.int64)) for k in ("kh", "sh", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.arange(count) - row["before"]), *same], names=["w", "d", "kh", "sh", "n"])


def _compared(cut: DataFrame, length: int, gram: int, group: int) -> DataFrame:
    """``(kh, sh, spans)`` for different runs with their bytes; ``group`` is the number from which windows are counted."""
    sizes = written(cut.groupBy("kh").count().where(F.col("count") > group).select("kh"))
    few = cut.join(sizes, "kh", "left_anti")
    head = F.substring("bytes", F.col("before").cast("int") + 1, F.lit(2 * gram))
    dealt = few.withColumn("head", head).repartitionByRange("head").sortWithinPartitions("head").select(*cut.columns)
    sorted_ = written(dealt.mapInArrow(lambda b: _sorted_buckets(b, length, True), FOUND))
    ends = sorted_.where("spans is null").repartition("g").sortWithinPartitions("g").mapInArrow(lambda b: _sorted_buckets(b, length, False), FOUND)
    out = sorted_.where("spans is not null").unionByName(ends).select("kh", "sh", "spans")
    if not sizes.limit(1).count():
        return out
    rows = cut.join(sizes, "kh", "left_semi").mapInArrow(lambda b: _window_rows(b, length), "w long, d long, kh long, sh long, n long")
    rows = written(rows)
    twice = rows.groupBy("kh", "d", "w").agg(F.sum("n").alias("times")).where("times > 1").select("kh", "d", "w")
    span = F.struct(F.col("d").alias("start"), (F.col("d") + length).alias("stop"))
    many = rows.join(twice, ["kh", "d", "w"], "left_semi").groupBy("kh", "sh").agg(F.collect_list(span).alias("spans"))
    return out.unionByName(many)


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``(doc_id, th, start, stop)``: intervals whose union is all that is repeated.

    ``docs`` has doc_id, th (a hash of the text, so that the two name a text)
    and raw (bytes). Intervals of a text may overlap, and equal rows share them.
    """
    if not 1 <= gram <= length <= 4096:
        raise ValueError("1 <= gram <= length <= 4096 is needed")
    with scratch(docs.sparkSession) as keep:
        levels = _gram_levels(docs, gram)
        runs = written(docs.select("doc_id", "th", "raw").mapInArrow(lambda b: _runs(b, length, gram, levels), RUNS))
        grams = written(runs.groupBy("kh").agg(F.count("*").alias("t")).where("t > 1"))
        total = grams.agg(F.sum("t").alias("t")).collect()[0]["t"] or 0
        shared = written(split_join(runs, grams.select("kh", (F.col("t") > total / HOT).alias("hot")), ["kh"], F.col("hot")).drop("hot"))
        one = F.min(F.struct("doc_id", "th", "place")).alias("one")
        different = written(shared.groupBy("kh", "sh").agg(F.count("*").alias("n"), one).select("kh", "sh", "n", "one.*"))
        key = F.coalesce("doc_id", F.lit(0).cast("long"))  # equal rows with a null id must meet, too
        wanted = different.groupBy(key.alias("_id"), "th").agg(F.collect_list(F.struct("place", "kh", "sh", "n")).alias("wanted"))
        texts = docs.select(F.col("th").alias("_th"), "raw", key.alias("_key")).join(wanted.hint("shuffle_hash"), (F.col("_key") == F.col("_id")) & (F.col("_th") == F.col("th")))
        # equal rows give the same runs; they are together already
        texts = texts.dropDuplicates(["_key", "_th"]).select("raw", "wanted")
        cut = written(texts.mapInArrow(lambda b: _cut_runs(b, length, gram), FOUND).drop("spans"))
        found = written(_compared(cut, length, gram, group))
        often = different.where(F.col("n") > total / HOT).select("kh", "sh", F.lit(True).alias("hot"))
        found = found.join(F.broadcast(often), ["kh", "sh"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        back = split_join(shared, found, ["kh", "sh"], F.col("hot"))
        anchor = F.shiftright("place", 2 * SPOT)
        each = back.select("doc_id", "th", anchor.alias("a"), F.explode("spans").alias("span"))
        return keep(each.select("doc_id", "th", (F.col("a") + F.col("span.start")).alias("start"), (F.col("a") + F.col("span.stop")).alias("stop")))


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left without the union of ``spans``, bytes removed, and removed runs (touching ones are one)."""
    kept, removed, count, at = [], 0, 0, -1
    for start, stop in sorted(spans):
        if start > at:
            count += 1
            kept.append(raw[max(at, 0) : start])
            removed += stop - start
            at = stop
        elif stop > at:
            removed += stop - at
            at = stop
    return b"".join([*kept, raw[max(at, 0) :]]), removed, count


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``docs`` with ``kept`` (bytes), ``kept_text``, ``n_bytes``, ``n_removed`` and ``n_spans``.

    In ``kept_text`` parts of a character at a cut go with it; a text without
    repeats, or null, is itself.

    Every byte covered by a string of ``length`` bytes that also starts
    elsewhere in ``docs`` (same text included) goes; all copies go. Null texts
    are empty, texts under ``length`` bytes stay whole. Repeated rows are
    copies of each other; null ids are allowed. Other columns pass through,
    but for names beginning with an underscore, which are taken. An empty
    table gives no rows.
    """
    small_batches(docs.sparkSession)
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    named = docs.withColumn("_th", F.xxhash64(raw))
    spans = repeated_spans(docs.select("doc_id", F.xxhash64(raw).alias("th"), raw.alias("raw")), length, gram, group)
    key = F.coalesce("doc_id", F.lit(0).cast("long"))
    of = spans.groupBy(key.alias("_id"), F.col("th").alias("_of")).agg(F.collect_set(F.struct("start", "stop")).alias("_spans"))

    @F.arrow_udf("kept binary, n_removed long, n_spans long, kept_text string")
    def removed(raw: pa.Array, spans: pa.Array) -> pa.Array:
        rows = [cut_out(r, [(x["start"], x["stop"]) for x in s or ()]) for r, s in zip(raw.to_pylist(), spans.to_pylist())]
        columns = list(zip(*rows)) or [[]] * 3
        text = pa.array([x.decode("utf-8", "ignore") for x in columns[0]], pa.string())
        return pa.StructArray.from_arrays([pa.array(columns[0], pa.binary()), *(pa.array(x, pa.int64()) for x in columns[1:]), text], ["kept", "n_removed", "n_spans", "kept_text"])

    joined = named.withColumn("_key", key).join(
        of.hint("shuffle_hash"), (F.col("_key") == F.col("_id")) & (F.col("_th") == F.col("_of")), "left"
    )
    return (
        joined.withColumn("_out", removed(raw, "_spans"))
        .withColumns({"n_bytes": F.octet_length(raw).cast("long"), "kept": F.col("_out.kept"), "n_removed": F.col("_out.n_removed"), "n_spans": F.col("_out.n_spans"), "kept_text": F.when(F.col("_out.n_removed") > 0, F.col("_out.kept_text")).otherwise(F.col("text"))})
        .drop("_th", "_key", "_id", "_of", "_spans", "_out")
    )


def clean_text(docs: DataFrame, length: int = 400) -> DataFrame:
    """``docs`` with repeats cut from ``text`` and n_chars anew."""
    columns = docs.columns
    out = remove_repeats(docs, length)
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(*columns)
