"""Removal of word windows that an earlier document has, by difference-cover anchors.

A window of ``length`` words goes from a document if its words also start in a
document of a smaller id. Instead of a row for each window, anchors (shorter
runs of words) are hashed only where their place modulo ``period`` is in a
difference cover: for any two places there is a shift under ``period`` that
takes both into the cover, so two equal windows share an anchor that lies at
the same distance from their starts. Of the period 7 that is 3 of 7 places.

1. Texts that many rows have keep one row, that of the smallest id: all
   windows of the others are in it.
2. Anchors are summed up to their smallest and largest id. Those of a single
   document go; where the others are in the texts comes from a second look.
3. Each such place extends to the windows about it. Windows are counted by 128
   bits of their bytes; those whose smallest id is smaller than the document's
   own are removed.

No step makes pairs: what a passage costs is linear in the documents with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import HOT, SMALL, lookup, scratch, small_batches
from tidemark.llm.prefix_hash import Hashed, forget, segments, words

LENGTH = 13
PERIOD = 7
#: Bytes of texts hashed at a time.
CHUNK = 1 << 20
#: Stands for a null id, which comes after all others.
LAST = (1 << 63) - 1


def difference_cover(period: int) -> tuple[int, ...]:
    """The smallest set of residues (the first of its size) whose differences give every residue."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            found = (0, *rest)
            if len({(a - b) % period for a in found for b in found}) == period:
                return found
    raise ValueError("the period must be positive")


def _anchors(texts: list[bytes], length: int, period: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some of the texts at a time: their numbers, places in the cover, and hashes of the words from there.

    A hash is that of ``length - period + 1`` words. Texts without a window have
    none; long ones come in parts.
    """
    wide = length - period + 1
    in_cover = np.isin(np.arange(period), difference_cover(period))
    parts: list[bytes] = []
    owner: list[int] = []
    base: list[int] = []
    weight = 0

    def found() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = b"\n".join(parts)
        starts, stops, closing = words(raw)
        last = np.flatnonzero(closing)
        part = np.cumsum(closing) - closing
        first = np.concatenate(([0], last[:-1] + 1))
        each = np.arange(len(starts))
        place = each - first[part] + np.array(base)[part]
        at = each[(each + wide - 1 <= last[part]) & in_cover[place % period]]
        a = Hashed(np.frombuffer(raw, np.uint8), 1).ranges(starts[at], stops[at + wide - 1])
        return np.array(owner)[part[at]], place[at].astype(np.int32), a.view(np.int64)

    for k, raw in enumerate(texts):
        text = b" ".join(raw.split())
        count = text.count(b" ") + 1
        if count < length:
            continue
        done = 0
        for piece in (text,) if len(text) <= CHUNK else segments(text, wide, CHUNK):
            parts.append(piece)
            owner.append(k)
            base.append(done)
            done += (piece.count(b" ") + 1) - (wide - 1)
            weight += len(piece) + 1
            if weight >= CHUNK:
                yield found()
                parts, owner, base, weight = [], [], [], 0
    if parts:
        yield found()


def _numbers(batches: Iterator[pa.RecordBatch], length: int, period: int) -> Iterator[pa.RecordBatch]:
    """``(a, id)``: the anchors of texts."""
    for batch in batches:
        for owner, _, a in _anchors(batch.column(1).to_pylist(), length, period):
            yield pa.RecordBatch.from_arrays([pa.array(a), batch.column(0).take(pa.array(owner))], names=["a", "id"])
    forget()


def _places(batches: Iterator[pa.RecordBatch], length: int, period: int) -> Iterator[pa.RecordBatch]:
    """``(a, id, text, at)``: all anchors with their texts and places."""
    for batch in batches:
        for owner, at, a in _anchors(batch.column(1).to_pylist(), length, period):
            index = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(a), batch.column(0).take(index), batch.column(2).take(index), pa.array(at)], names=["a", "id", "text", "at"])
    forget()


def _windows(batches: Iterator[pa.RecordBatch], length: int, period: int) -> Iterator[pa.RecordBatch]:
    """``(h1, h2, id, text, start)`` for the windows about the places ``at``; ``(raw, at, id, text)`` come in."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    for batch in batches:
        for k, (raw, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            text = b" ".join(raw.split())
            begins, ends, _ = words(text)
            last = len(begins) - length
            mark = np.zeros(last + 2, np.int32)
            at = np.array(at)
            np.add.at(mark, np.maximum(at - period + 1, 0), 1)
            np.add.at(mark, np.minimum(at, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            pairs = zip(begins[starts].tolist(), ends[starts + length - 1].tolist())
            hashes = np.frombuffer(b"".join([digest(text[x:y]) for x, y in pairs]), np.int64).reshape(-1, 2)
            same = pa.array(np.full(len(starts), k))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), batch.column(2).take(same), batch.column(3).take(same), pa.array(starts.astype(np.int32))],
                names=["h1", "h2", "id", "text", "start"],
            )


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """``(doc_id, n_words, spans, kept)`` from ``(doc_id, raw, low, starts, id)``; of a copy (its id is above ``low``) every window goes."""
    pair = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        _, raws, lows, starts, ids = (batch.column(k).to_pylist() for k in range(5))
        n_words, spans, kept = [], [], []
        for raw, low, found, own in zip(raws, lows, starts, ids):
            all_ = raw.split()
            if low is not None and own > low:
                cut = [(0, len(all_))] if len(all_) >= length else []
            else:
                cut = []
                for s in sorted(found or ()):
                    if cut and s <= cut[-1][1]:
                        cut[-1] = (cut[-1][0], s + length)
                    else:
                        cut.append((s, s + length))
            rest, done = [], 0
            for x, y in cut:
                rest += all_[done:x]
                done = y
            n_words.append(len(all_))
            spans.append([{"start": x, "stop": y} for x, y in cut])
            kept.append(b" ".join(rest + all_[done:]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pair), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "spans", "kept"],
        )


def _hot(sums: DataFrame) -> Column:
    """Whether a key has over one in ``HOT`` of all ``t``."""
    every = sums.agg(F.sum("t").alias("t")).collect()[0]["t"] or 0
    return F.col("t") > every / HOT


def remove_repeats(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, spans, kept)``: the spans of words removed from each row, and what is left, joined by single spaces.

    Words are runs without ASCII white space, taken as they are. A null text
    has none; texts of fewer than ``length`` words keep all. Windows are judged
    on the input. Rows that share an id aren't earlier than each other, and a
    null id (or the largest long) comes after all others. Every row gives a
    row; other columns are ignored, and an empty table gives no rows.
    """
    if not 1 <= period <= length:
        raise ValueError("1 <= period <= length is needed")
    spark = docs.sparkSession
    small_batches(spark)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("raw"))
    rows = rows.select("doc_id", "raw", F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.unhex(F.md5("raw")).alias("th"))
    # an id and 60 bits of its text stand for a row; copies are known by 128 bits
    text = F.conv(F.substring(F.md5("raw"), 1, 15), 16, 10).cast("long").alias("text")
    with scratch(spark) as keep_all:
        # leaving copies out spares work and changes nothing, so a table of any size will do: the hot ones at most
        copies = keep_all(rows.groupBy("th").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1"))
        if copies.count() > SMALL:
            total = rows.count()
            copies = copies.where(F.col("n") > total / HOT)
        copies = F.broadcast(copies.select("th", "low"))
        single = rows.join(copies, "th", "left").where("low is null or id = low").select("id", "raw", text)
        with scratch(spark):
            with scratch(spark) as keep:
                numbers = single.select("id", "raw").mapInArrow(lambda b: _numbers(b, length, period), "a long, id long")
                sums = numbers.groupBy("a").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("t"))
                shared = keep(sums.where("lo < hi").select("a", "t"))
            with scratch(spark) as keep:
                places = single.mapInArrow(lambda b: _places(b, length, period), "a long, id long, text long, at int")
                met = lookup(places, shared, ["a"], _hot(shared))
                at = keep(met.groupBy("text", "id").agg(F.collect_set("at").alias("at")))
            with scratch(spark) as keep:
                about = keep(single.join(at, ["text", "id"]).select("raw", "at", "id", "text"))
            with scratch(spark) as keep:
                windows = about.mapInArrow(lambda b: _windows(b, length, period), "h1 long, h2 long, id long, text long, start int")
                sums = windows.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("t"))
                earlier = keep(sums.where("lo < hi").select("h1", "h2", "lo", "t"))
            gone = lookup(windows, earlier, ["h1", "h2"], _hot(earlier)).where("lo < id")
            spans = keep_all(gone.groupBy("text", "id").agg(F.collect_set("start").alias("starts")))
    known = rows.join(copies, "th", "left")
    later = F.coalesce(F.col("id") > F.col("low"), F.lit(False))
    # what is known to be a copy needs no look at the spans
    first = known.where(~later).withColumn("text", text).join(spans, ["text", "id"], "left")
    rest = known.where(later).withColumn("starts", F.lit(None).cast("array<int>"))
    columns = ["doc_id", "raw", "low", "starts", "id"]
    cut = first.select(*columns).unionByName(rest.select(*columns))
    return cut.mapInArrow(lambda b: _cut(b, length), "doc_id long, n_words long, spans array<struct<start:int,stop:int>>, kept string")
