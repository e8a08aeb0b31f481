"""ST4: a table that micro-batches are merged into by key, each batch once.

Rows are dealt into buckets by a hash of their key. There are as many buckets
as rows need (linear hashing): with n buckets, 2**k <= n, the address is the hash
modulo 2**(k+1), or modulo 2**k where that bucket isn't there yet. One more
bucket takes rows only from one that there is, so a growing table rewrites the
buckets that a batch names and those that split, never the rest.

A batch writes its buckets into ``data/v=<version>/bucket=<b>``, several files
for a large one; small ones share the folder of the first of them, so that there
are as many files as rows need, however small buckets are. Then a file
``commits/<version>`` says which version of each bucket holds now, how many rows
it has and in which folder it is. What isn't committed isn't there: a batch that
failed midway is written again, one that was committed is left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.sources import writers

#: Rows that a bucket has on average at most, rows of a file, and rows up to which buckets share a folder.
ROWS, FILE_ROWS, FOLDER_ROWS = 1_000_000, 1_000_000, 200_000
#: Buckets up to which a read names them, so that pages of files can be left out.
FEW = 10


#: A bucket without rows.
EMPTY = (-1, 0, -1)


#: What rows in files have beside the table's columns.
_PLACE = [StructField("_bucket", IntegerType()), StructField("_version", IntegerType())]


@dataclass
class Commit:
    """The last batch of each source, and for each bucket the version that holds, its rows and its folder."""

    version: int
    batches: dict[str, int] = field(default_factory=dict)
    held: list[tuple[int, int, int]] = field(default_factory=list)

    @property
    def rows(self) -> int:
        return sum(n for _, n, _ in self.held)


def address(keys: list[str], buckets: int) -> Column:
    """The bucket of a key among ``buckets``."""
    whole = 1 << (buckets.bit_length() - 1)
    h = F.xxhash64(*keys)
    wide = F.pmod(h, F.lit(2 * whole))
    return F.when(wide < buckets, wide).otherwise(F.pmod(h, F.lit(whole))).cast("int")


def parent(bucket: int) -> int:
    """The bucket that ``bucket`` was split from."""
    return bucket - (1 << (bucket.bit_length() - 1)) if bucket else 0


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], rows: int = ROWS, buckets: int = 1):
        self.spark, self.path, self.schema, self.keys, self.rows, self.buckets = spark, path.rstrip("/"), schema, keys, rows, buckets
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    # -- commits

    def versions(self) -> list[int]:
        """All committed versions that are still kept, oldest first."""
        return sorted(int(x) for x in self._names(f"{self.path}/commits") if x.isdigit())

    def commit(self, version: int | None = None) -> Commit:
        """What holds in ``version``, or now; before the first commit an empty table."""
        known = self.versions()
        if version is None and not known:
            return Commit(-1, {}, [EMPTY] * self.buckets)
        number = known[-1] if version is None else version
        said = json.loads(self.spark.read.text(f"{self.path}/commits/{number}", wholetext=True).first()[0])
        return Commit(said["version"], said["batches"], [tuple(x) for x in said["held"]])

    def _put(self, commit: Commit) -> None:
        """Under a name of its own first; a version that is there already isn't replaced."""
        text = json.dumps({"version": commit.version, "batches": commit.batches, "held": commit.held})
        draft, place = self._path(f"{self.path}/drafts/{commit.version}"), self._path(f"{self.path}/commits/{commit.version}")
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(place.getParent())
        if self._fs.exists(place) or not self._fs.rename(draft, place):
            raise RuntimeError(f"version {commit.version} was committed by another writer")

    # -- reading

    def _folders(self, commit: Commit, buckets: list[int]) -> list[str]:
        return [f"{self.path}/data/v={v}/bucket={f}" for v, f in sorted({(commit.held[b][0], commit.held[b][2]) for b in buckets if commit.held[b][0] >= 0})]

    def _rows(self, commit: Commit, buckets: list[int]) -> DataFrame:
        """The rows of ``buckets``; what folders have of others, or of older versions of them, is left out."""
        folders = self._folders(commit, buckets)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        wanted = set(buckets)
        holds = [v if b in wanted else -1 for b, (v, *_) in enumerate(commit.held)]
        kinds = StructType([*self.schema.fields, *_PLACE])
        # the version of each bucket as one constant: a number for each bucket
        live = F.get(F.split(F.lit(",".join(map(str, holds))), ",").cast("array<int>"), F.col("_bucket")) == F.col("_version")
        rows = self.spark.read.schema(kinds).parquet(*folders).where(live)
        return (rows.where(F.col("_bucket").isin(buckets)) if len(buckets) <= FEW else rows).select(*self.schema.names)

    def read(self, version: int | None = None) -> DataFrame:
        """The table now, or as it was in ``version``; only the folders that hold are listed."""
        commit = self.commit(version)
        return self._rows(commit, list(range(len(commit.held))))

    # -- writing

    def _write(self, rows: DataFrame, before: Commit, buckets: int, touched: list[int]) -> Commit:
        """``rows`` (with ``_bucket``) as the buckets ``touched`` of the next version, which isn't committed yet."""
        version = before.version + 1
        data = f"{self.path}/data/v={version}"
        held = [*before.held, *[EMPTY] * buckets][:buckets]
        span = max(1, FOLDER_ROWS // self.rows)
        sizes: dict[int, int] = {}
        for b in touched:
            sizes[b // span] = sizes.get(b // span, 0) + held[b][1]
        # a large folder is written by several tasks
        salt = max(1, -(-max(sizes.values(), default=0) // FILE_ROWS))
        folder = (F.col("_bucket") - F.col("_bucket") % span).alias("bucket")
        dealt = rows.select(*self.schema.names, "_bucket", F.lit(version).alias("_version"), folder)
        dealt = dealt.withColumn("_salt", F.pmod(F.xxhash64(*self.keys, F.lit(1)), F.lit(salt))).repartition("bucket", "_salt").drop("_salt")
        dealt.sortWithinPartitions("bucket", "_bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        counts = self.spark.read.schema(StructType(_PLACE)).parquet(data).groupBy("_bucket").count().collect()  # a row for each bucket
        found = {r["_bucket"]: r["count"] for r in counts}
        for b in touched:
            held[b] = (version, found[b], b - b % span) if b in found else EMPTY
        return Commit(version, dict(before.batches), held)

    def merge(self, changes: DataFrame, batch: int, update: list[str], order: str, source: str = "") -> Commit:
        """K01-K06 with a batch of ``changes`` (see ``writers.upsert``), once for each number of a ``source``.

        Numbers grow; one that was committed, or one before it, changes nothing.
        """
        before = self.commit()
        if batch <= before.batches.get(source, -1):
            return before
        there = len(before.held)
        one = writers.reduced(changes, self.schema.names, self.keys, update, order)
        # keys that are known count twice here, which only splits a little sooner
        wanted = max(there, -(-(before.rows + changes.select(*self.keys).distinct().count()) // self.rows))
        named = {r["_bucket"] for r in changes.select(address(self.keys, wanted).alias("_bucket")).distinct().collect()}  # a number for each bucket
        named.update(range(there, wanted))
        # all rows of a new bucket come from the one that it was split from, which is written again with all its parts
        old = set()
        for b in named:
            while b >= there:
                b = parent(b)
            old.add(b)
        target = self._rows(before, sorted(old))
        merged = writers.applied(target, one, self.keys, update).withColumn("_bucket", address(self.keys, wanted))
        out = self._write(merged, before, wanted, sorted(named | old))
        out.batches[source] = batch
        self._put(out)
        return out

    def compact(self) -> Commit:
        """The table written anew, in as many buckets as its rows need, fewer ones too."""
        before = self.commit()
        wanted = max(1, -(-before.rows // self.rows))
        out = self._write(self.read().withColumn("_bucket", address(self.keys, wanted)), Commit(before.version, before.batches, []), wanted, list(range(wanted)))
        self._put(out)
        return out

    def expire(self, keep: int = 1) -> list[str]:
        """What only versions before the last ``keep`` hold goes, as does what was never committed; the folders removed."""
        known = self.versions()
        kept = [self.commit(v) for v in known[-keep:]]
        needed = {f for c in kept for f in self._folders(c, list(range(len(c.held))))}
        gone = []
        for v in self._names(f"{self.path}/data"):
            for b in self._names(f"{self.path}/data/{v}"):
                folder = f"{self.path}/data/{v}/{b}"
                if b.startswith("bucket=") and folder not in needed:
                    self._fs.delete(self._path(folder), True)
                    gone.append(folder)
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.path}/commits/{v}"), False)
        return gone


def upserting(path: str, keys: list[str], update: list[str], order: str, buckets: int = 1, rows: int = ROWS, source: str = "") -> Callable[[DataFrame, int], None]:
    """ST4: a writer for ``drain``; ``buckets`` are there from the start, more come with the rows."""

    def write(batch: DataFrame, number: int) -> None:
        kinds = StructType([f for f in batch.schema.fields if f.name != order])
        KeyedTable(batch.sparkSession, path, kinds, keys, rows, buckets).merge(batch, number, update, order, source)

    return write


def current(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """ST4: the table that ``upserting`` keeps; a folder that isn't there yet is an empty one."""
    return KeyedTable(spark, path, schema, []).read()
