"""Phrase collocations: counts of weighted n-grams, and scores from the counts of a phrase's parts.

1. Texts are split into pieces at punctuation; identical pieces of a language
   become one with a multiplicity.
2. N-grams are counted size by size. Each task counts those of its bucket of
   pieces in duckdb, out of core; partial counts are dealt into hash buckets of
   phrases, and duckdb sums each bucket and leaves what is frequent.
3. A phrase can't be more frequent than its parts, so n-grams are only made
   where both n-grams of one word less may be frequent. That is told from a bit
   set of bounded size: it may let rare ones through, which their counts then
   remove, and never holds back a frequent one.
4. Every cut of a candidate asks for the counts of both parts. Each part is
   looked up once, by a shuffled join; the answers go back to the cuts, those of
   parts that very many cuts ask for by broadcast.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import HOT, LOWER, scratch, shared_dir, small, small_batches, split_join
from tidemark.llm.prefix_hash import Hashed, forget, segments, words

#: Where texts are split into pieces, and what is between the words of a piece.
SPLIT, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: In lower case, with one byte for all ends of pieces, and one for blanks.
PLAIN = bytes(10 if c in SPLIT else 32 if c in BLANKS else c for c in LOWER)
LONGEST = 4
#: Rows in an Arrow batch of pieces or phrases, and bytes of pieces taken together.
ROWS = 8192
CHUNK = 1 << 20
#: Memory of a task's duckdb, and rows that a task counts before it hands on what it has.
MEMORY, FLUSH = "160MB", 1_000_000
#: Words for a bucket of phrases.
BUCKET_WORDS = 1 << 23
#: Bits for each frequent phrase, and at most (32 MB).
BITS, MOST_BITS = 16, 28
#: Parts of phrases with their counts that may be broadcast, some 10 MB; more are joined.
FACTS = 1 << 16
#: Parts that the phrases of one language are dealt into before the first are taken.
SALT = 16
UNKNOWN = "und"
_COUNTS = "lang string, phrase string, n long"


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, piece, n, words)`` from ``(lang, raw)``: words of a piece are joined by single spaces."""
    for batch in batches:
        found: dict[str, Counter[bytes]] = {}
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            pieces = [b" ".join(p.split()) for p in raw.translate(PLAIN).split(b"\n")]
            found.setdefault(lang, Counter()).update(pieces)
        for lang, counts in found.items():
            counts.pop(b"", None)
            texts = list(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(texts), pa.string()),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                    pa.array(list(counts.values()), pa.int64()),
                    pa.array([x.count(b" ") + 1 for x in texts], pa.int64()),
                ],
                names=["lang", "piece", "n", "words"],
            )


def _salts(langs: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs], np.uint64)


class _Bits:
    """Which hashes may be those of frequent phrases."""

    def __init__(self, words: np.ndarray, power: int):
        self.words, self.power = words, power

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.power)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


class _Store:
    """Counts of phrases in a duckdb of this task; ``folder``, shared by all machines, takes what memory can't hold."""

    def __init__(self, folder: str | None):
        import duckdb

        self.folder = folder and os.path.join(folder, f"duckdb-{uuid.uuid4().hex}")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "preserve_insertion_order": False, "temp_directory": self.folder or ""})
        self.rows = 0
        self._new()

    def _new(self) -> None:
        self.db.execute("CREATE OR REPLACE TABLE counts (lang VARCHAR, phrase VARCHAR, n BIGINT)")

    def add(self, counts: pa.Table | pa.RecordBatch) -> None:
        part = pa.Table.from_batches([counts]) if isinstance(counts, pa.RecordBatch) else counts  # noqa: F841  read by name
        self.db.execute("INSERT INTO counts SELECT lang, phrase, n FROM part")
        self.rows += part.num_rows

    def take(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        """The sums, of which the store is emptied."""
        found = self.db.sql(f"SELECT lang, phrase, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY lang, phrase HAVING sum(n) >= {int(least)}")
        yield from found.to_arrow_reader(ROWS)
        self.rows = 0
        self._new()

    def close(self) -> None:
        import gc

        self.db.close()
        forget()  # tasks have tables of their own, and workers outlive tasks
        gc.collect()
        if self.folder and os.path.isdir(self.folder):
            import shutil

            shutil.rmtree(self.folder, ignore_errors=True)


def _chunk(pieces: list[bytes], langs: np.ndarray, names: list[str], n: np.ndarray, size: int, bits: _Bits | None) -> pa.Table:
    """Counts of the n-grams of some pieces; ``langs`` are places in ``names``. Equal are those with 128 equal bits of hashes."""
    raw = b"\n".join(pieces)
    starts, stops, closing = words(raw)
    last = np.flatnonzero(closing)
    owner = np.cumsum(closing) - closing
    at = np.flatnonzero(np.arange(len(starts)) + size - 1 <= last[owner])
    hashed, salt = Hashed(np.frombuffer(raw, np.uint8)), _salts(names)[langs][owner]
    if bits and len(at):
        left = bits.has(hashed.ranges(starts[at], stops[at + size - 2], salt[at]))
        at = at[left]
        at = at[bits.has(hashed.ranges(starts[at + 1], stops[at + size - 1], salt[at]))]
    first, second = (hashed.ranges(starts[at], stops[at + size - 1], salt[at], lane) for lane in (0, 1))
    order = np.argsort(first, kind="stable")
    if len(at) > 1 and ((first[order][1:] == first[order][:-1]) & (second[order][1:] != second[order][:-1])).any():
        order = np.lexsort((second, first))
    new = np.flatnonzero(np.diff(first[order], prepend=~first[order][:1]) | np.diff(second[order], prepend=~second[order][:1]))
    sums = np.add.reduceat(n[owner[at]][order], new) if len(at) else np.zeros(0, np.int64)
    one = at[order[new]]
    phrases = [raw[x:y] for x, y in zip(starts[one].tolist(), stops[one + size - 1].tolist())]
    lang = pa.array(names, pa.string()).take(pa.array(langs[owner[one]]))
    return pa.table({"lang": lang, "phrase": pa.array(phrases, pa.binary()).cast(pa.string()), "n": pa.array(sums)})


def _grams(batches: Iterator[pa.RecordBatch], size: int, bits: _Bits | None, folder: str | None) -> Iterator[pa.RecordBatch]:
    """``(lang, phrase, n)`` of the n-grams of this bucket of pieces ``(lang, piece, n)``."""
    store = _Store(folder)
    pieces: list[bytes] = []
    owner: list[np.ndarray] = []
    weight = 0
    names: dict[str, int] = {}
    times: list[np.ndarray] = []

    def count() -> None:
        nonlocal pieces, owner, times, weight
        if pieces:
            store.add(_chunk(pieces, np.concatenate(owner), list(names), np.concatenate(times), size, bits))
        pieces, owner, times, weight = [], [], [], 0

    try:
        for batch in batches:
            lang = pa.array(batch.column(0)).dictionary_encode()
            code = np.array([names.setdefault(x, len(names)) for x in lang.dictionary.to_pylist()], np.int64)[lang.indices.to_numpy()]
            found, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            if max(map(len, found), default=0) > CHUNK:  # long ones come in parts
                parts = [list(segments(x, size, CHUNK)) for x in found]
                each = np.repeat(np.arange(len(found)), list(map(len, parts)))
                found, code, n = [y for x in parts for y in x], code[each], n[each]
            sizes = np.cumsum([len(x) + 1 for x in found])
            at = 0
            while at < len(found):
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK - weight)))
                pieces += found[at:upto]
                owner.append(code[at:upto])
                times.append(n[at:upto])
                weight += int(sizes[upto - 1] - (sizes[at - 1] if at else 0))
                at = upto
                if weight >= CHUNK or at < len(found):
                    count()
            if store.rows >= FLUSH:
                yield from store.take()
        count()
        yield from store.take()
    finally:
        store.close()


def _sums(batches: Iterator[pa.RecordBatch], least: int, folder: str | None) -> Iterator[pa.RecordBatch]:
    """The frequent phrases of a bucket of partial counts."""
    store = _Store(folder)
    try:
        for batch in batches:
            store.add(batch)
        yield from store.take(least)
    finally:
        store.close()


def _frequent_bits(frequent: DataFrame) -> tuple[np.ndarray, int]:
    """What ``_Bits`` needs. At most 2**``MOST_BITS`` bits, whatever the number of phrases; set by tasks, gathered as words of 64."""
    wanted = max(frequent.count(), 1) * BITS
    power = int(min(MOST_BITS, max(16, np.ceil(np.log2(wanted)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_ = np.zeros(1 << (power - 6), np.uint64)
        for batch in batches:
            names = batch.column(0).unique().to_pylist()
            salt = _salts(names)[pa.array(batch.column(0)).dictionary_encode().indices.to_numpy()]
            phrases = batch.column(1).to_pylist()
            ends = np.cumsum([len(x) for x in phrases])
            hashed = Hashed(np.frombuffer(b"".join(phrases), np.uint8), 1)
            at = hashed.ranges(np.concatenate(([0], ends[:-1])), ends, salt) >> np.uint64(64 - power)
            np.bitwise_or.at(set_, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        forget()
        block = np.flatnonzero(set_)
        yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(set_[block].view(np.int64))], names=["block", "bits"])

    parts = frequent.select("lang", F.col("phrase").cast("binary")).mapInArrow(run, "block int, bits long")
    found = parts.groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (power - 6), np.int64)
    out[found["block"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64), power


def _spill_folder(spark: SparkSession) -> str | None:
    """The shared folder, where it is one that processes can open; else duckdb has its memory alone."""
    at = urlparse(shared_dir(spark))
    return at.path if at.scheme in ("", "file") else None


def _pieces_table(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw")
    each = docs.select(F.coalesce(lang_col, F.lit(UNKNOWN)).alias("lang"), raw).mapInArrow(_pieces, "lang string, piece string, n long, words long")
    return each.groupBy("lang", "piece").agg(F.sum("n").alias("n"), F.first("words").alias("words"))


def frequent_phrases(pieces: DataFrame, total: int, least: int, longest: int) -> list[DataFrame]:
    """A table ``(lang, phrase, n)`` for each size up to ``longest`` of what occurs ``least`` times in ``pieces`` of ``total`` words."""
    spark = pieces.sparkSession
    folder = _spill_folder(spark)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_WORDS))
    found: list[DataFrame] = []
    source = pieces.select("lang", F.col("piece").cast("binary"), "n", "words")
    for size in range(1, longest + 1):
        bits, power = _frequent_bits(found[-1]) if found else (None, 0)
        sent = spark.sparkContext.broadcast(bits)
        with scratch(spark) as keep:
            own = source.where(F.col("words") >= size).select("lang", "piece", "n")
            parts = own.mapInArrow(lambda b, k=size, s=sent, p=power: _grams(b, k, None if k == 1 else _Bits(s.value, p), folder), _COUNTS)
            dealt = parts.repartition(buckets, "lang", "phrase")
            found.append(keep(dealt.mapInArrow(lambda b: _sums(b, least, folder), _COUNTS)))
    return found


def _scored(candidates: DataFrame, known: DataFrame, factor: int, keep) -> DataFrame:
    """``(lang, phrase, a, l, r, score)``: the cut of the lowest score, of several the first."""
    last = F.size(F.split("phrase", " ")) - 1
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), last)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    cuts = keep(cuts)
    asked = cuts.select("lang", F.explode(F.array("first", "rest")).alias("part")).groupBy("lang", "part").agg(F.count("*").alias("asks"))
    answers = keep(asked.join(known.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"]))
    total = answers.agg(F.sum("asks").alias("t")).collect()[0]["t"] or 0
    for part, name in (("first", "l"), ("rest", "r")):
        facts = answers.select("lang", F.col("part").alias(part), F.col("f").alias(name), "asks")
        cuts = split_join(cuts, facts, ["lang", part], F.col("asks") > total / HOT, FACTS).drop("asks")
    exact = f"cast((cast({factor} as decimal(18, 0)) * cast(a as decimal(19, 0))) div cast(l + r as decimal(20, 0)) as long)"
    best = F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def mine(
    docs: DataFrame,
    least: int = 30,
    longest: int = LONGEST,
    top: int = 2000,
    within: int = 80,
    factor: int = 2_000_000,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language.

    A candidate has 2 to ``longest`` words and a count a of ``least`` or more.
    Its score is ``factor * a`` over the counts l + r of the parts of its worst
    cut, rounded down. One goes if a longer candidate that contains it has
    ``within`` hundredths of its count. n counts the words of the language.
    Ties go by a, then by the phrase in byte order.

    A null language is ``und``. Null and empty texts, and those of blanks and
    punctuation alone, have no words. Repeated rows count as often as they are
    there. Other columns are ignored; empty tables give no rows.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words at least, and occur")
    spark = docs.sparkSession
    small_batches(spark)
    with scratch(spark) as keep_all:
        with scratch(spark) as keep:
            pieces = keep(_pieces_table(docs, text_col, lang_col))
        totals = keep_all(pieces.groupBy("lang").agg(F.sum(F.col("n") * F.col("words")).alias("n")))
        total = totals.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
        with _batches_of(spark, ROWS):
            found = frequent_phrases(pieces, total, least, longest)
        known = found[0]
        for table in found[1:]:
            known = known.unionByName(table)
        long = found[1].select("lang", "phrase", F.col("n").alias("a"))
        for table in found[2:]:
            long = long.unionByName(table.select("lang", "phrase", F.col("n").alias("a")))
        split = F.split("phrase", " ")
        inside = None
        for size in range(2, longest):  # parts of this size in longer phrases
            starts = F.sequence(F.lit(1), F.size(split) - size + 1)
            part = F.transform(starts, lambda i: F.array_join(F.slice(split, i, F.lit(size)), " "))  # noqa: B023  called at once
            one = long.where(F.size(split) > size).select("lang", F.explode(part).alias("phrase"), "a")
            inside = one if inside is None else inside.unionByName(one)
        with scratch(spark) as keep:
            scored = _scored(long, known, factor, keep)
            if inside is not None:
                most = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
                scored = scored.join(most, ["lang", "phrase"], "left").where(f"most is null or 100 * most < {within} * a").drop("most")
            order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
            part = F.pmod(F.xxhash64("phrase"), F.lit(SALT))
            first = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
            first = first.where(F.col("rank") <= top).drop("part", "rank")
            ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
            ranked = keep_all(ranked.where(F.col("rank") <= top))
    return ranked.join(small(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
