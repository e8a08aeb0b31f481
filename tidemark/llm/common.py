"""What the corpus operators share: tables, shared storage and components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: whole texts can be long, so batches stay small.
ARROW_ROWS = 256
#: Words hashed at a time, so that very long texts need little memory.
BLOCK = 1 << 16
#: A key with over this share (one in) of all rows is hot; there can be no more such keys.
HOT = 1000
#: Rows of a few numbers each that may be broadcast, some 10 MB; more are joined.
SMALL = 1 << 18
#: Bits of a cell's number in the counts of ``Sketch``.
CELL_BITS = 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers, and of scans, on tables with long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, only a session on one machine (tests) gets a
    folder of its own; on a cluster that is an error.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a narrow table, removed once nothing refers to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Paths written inside each open ``scratch``.
_OPEN: list[list[str]] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read again.

    Later stages read what was committed, so a lost executor never makes them
    see rows that were computed differently. The table goes when the ``scratch``
    it was written in closes, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    # small row groups: what a task holds while it writes is bounded
    df.write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    if _OPEN:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside go at the end, with the shuffle files of what made them.

    Yields a function that writes the result so that it stays.
    """
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        out = written(df)
        kept.append(_OPEN[-1].pop())
        return out

    _OPEN.append([])
    try:
        yield keep
    finally:
        for path in _OPEN.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if _OPEN:
            _OPEN[-1].extend(kept)
        spark._jvm.System.gc()  # lets Spark drop the files of shuffles that nothing refers to any more


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, root)``.

    Root is the smallest node reachable. Each round takes the smallest label
    among the neighbours and then jumps along labels, so a path of n nodes
    needs about log n rounds. Labels and links stay distributed; each round
    reads the checkpoint of the one before. Nodes without edges have no row.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpoint(both.where("a <> b").distinct())
    labels = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("root").alias("m"))
            .select(F.col("a").alias("node"), "m")
        )
        hooked = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        # a root that learnt of a smaller label passes it on to all that point to it
        pulled = hooked.groupBy(F.col("was").alias("node")).agg(F.min("root").alias("p"))
        hooked = checkpoint(
            hooked.join(pulled, "node", "left").select("node", "was", F.least("root", F.coalesce("p", "root")).alias("root"))
        )
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        labels = checkpoint(
            hooked.join(up, "root", "left").select("node", "was", F.least("root", F.coalesce("top", "root")).alias("root"))
        )
        moved = labels.where("root <> was").limit(1).count()
        labels = labels.select("node", "root")
        if not moved:
            return labels


def small(table: DataFrame) -> DataFrame:
    """A table of narrow rows, as ``written`` returns it, marked for broadcast if it has no more than ``SMALL`` rows."""
    return F.broadcast(table) if table.count() <= SMALL else table


def split_join(rows: DataFrame, facts: DataFrame, keys: list[str], hot: Column, most: int = SMALL) -> DataFrame:
    """``rows`` with the fact of their key, a row for each key in the table ``facts``.

    Tables of up to ``most`` rows are broadcast. Else the facts for which ``hot`` holds, ``HOT``
    at most, are, so that no task gets all rows of a hot key; the rest meet in
    a plain join.
    """
    if facts.count() <= most:
        return rows.join(F.broadcast(facts), keys)
    few = facts.where(hot)
    apart = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(facts.where(~hot), keys)
    return rows.join(F.broadcast(few), keys).unionByName(apart)


def lookup(rows: DataFrame, facts: DataFrame, keys: list[str], hot: Column, most: int = SMALL) -> DataFrame:
    """As ``split_join``, for rows that are dear to make: they are made once.

    Rows of hot keys have their facts from a broadcast and are dealt out in the
    join that the others need. Nulls in keys match nothing.
    """
    if facts.count() <= most:
        return rows.join(F.broadcast(facts), keys)
    others = [c for c in facts.columns if c not in keys]
    few = facts.where(hot).select(*keys, F.struct(F.lit(True).alias("is"), *others).alias("_hot"))
    known = facts.where(~hot).select(*keys, F.lit(0).cast("long").alias("_salt"), F.struct(F.lit(True).alias("is"), *others).alias("_fact"))
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(HOT)) + 1
    met = rows.join(F.broadcast(few), keys, "left").withColumn("_salt", F.when(F.col("_hot").isNotNull(), spread).otherwise(0))
    met = met.join(known, [*keys, "_salt"], "left").withColumn("_fact", F.coalesce("_hot", "_fact")).where("_fact is not null")
    return met.select(*rows.columns, *[F.col(f"_fact.{c}").alias(c) for c in others])


def shingle_hashes(raw: bytes, shingle: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 values of all ``shingle`` words in a row (ASCII lower case, space-joined), block by block.

    Words are runs without ASCII white space. Fewer words than ``shingle`` make one shingle, no words none.
    """
    import xxhash

    digest, words = xxhash.xxh64_intdigest, raw.translate(LOWER).split()
    if len(words) <= shingle:
        if words:
            yield np.array([digest(b" ".join(words), seed)], np.uint64)
        return
    for at in range(0, len(words) - shingle + 1, BLOCK):
        block = words[at : at + BLOCK + shingle - 1]
        joined = b" ".join(block)
        ends = np.cumsum(np.fromiter(map(len, block), np.int64, len(block)) + 1) - 1
        starts = np.concatenate(([0], ends[:-shingle] + 1))
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())], np.uint64)


class Sketch:
    """How common hashes are, roughly: counts over all rows, folded into cells.

    A task sends the cells that stand out in it and the sum of the others. The
    result orders hashes; whatever it says, those that use it stay exact.
    """

    SCHEMA = "cell int, count long"

    def __init__(self) -> None:
        self.cells = np.zeros(1 << CELL_BITS, np.int64)

    def add(self, hashes: np.ndarray) -> None:
        np.add.at(self.cells, (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)

    def batch(self) -> pa.RecordBatch:
        mean = self.cells.mean()
        out = np.flatnonzero(self.cells > mean + 6 * np.sqrt(mean) + 3)  # chance alone hardly ever puts a cell there
        n = self.cells[out]
        rest = int(self.cells.sum() - n.sum())
        return pa.RecordBatch.from_arrays([pa.array([*out.tolist(), -1], pa.int32()), pa.array([*n.tolist(), rest], pa.int64())], names=["cell", "count"])

    @staticmethod
    def levels(counts: DataFrame) -> np.ndarray:
        """A level for each cell: 0 up to four times the mean, then 1 to 15 by its logarithm.

        At most a quarter of the cells can be so full, which bounds what the driver gets.
        """
        counts = checkpoint(counts.groupBy("cell").agg(F.sum("count").alias("n")))
        mean = (counts.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0) / (1 << CELL_BITS)
        least = max(4 * mean, 4.0)
        out = np.zeros(1 << CELL_BITS, np.uint8)
        for r in counts.where((F.col("cell") >= 0) & (F.col("n") > least)).collect():
            out[r["cell"]] = min(15, 1 + int(np.log2(r["n"] / least)))
        return out


def level_of(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return levels[(hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
