"""A database in one file of the shared folder, for sessions whose executors can't reach a database of the driver's process.

The file's locks let one transaction write at a time, and all tasks read at once.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

PREFIX = "sqlite:"
#: Spark's types and the file's.
_TYPES = {"bigint": "bigint", "int": "int", "double": "double", "string": "text"}
#: Seconds that a task waits for the transactions of others.
_WAIT = 600


def connect(url: str) -> closing[sqlite3.Connection]:
    return closing(sqlite3.connect(url.removeprefix(PREFIX), timeout=_WAIT, isolation_level=None))


def exists(url: str, table: str) -> bool:
    with connect(url) as db:
        return bool(db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND lower(name) = lower(?)", (table,)).fetchone())


class _Range(InputPartition):
    def __init__(self, where: str):
        self.where = where


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.url, self.table, self.key, self.parts = options["url"], options["dbtable"], options["key"], int(options["partitions"])
        self.columns = ", ".join(f'"{c}"' for c in columns)

    def partitions(self) -> list[_Range]:
        with connect(self.url) as db:
            low, high = db.execute(f'SELECT min("{self.key}"), max("{self.key}") FROM "{self.table}"').fetchone()
        if low is None or self.parts < 2:
            return [_Range("1")]
        ends = [low + (high + 1 - low) * k // self.parts for k in range(1, self.parts)]
        first = f'"{self.key}" IS NULL' + (f' OR "{self.key}" < {ends[0]}')
        return [_Range(first), *[_Range(f'"{self.key}" >= {a} AND "{self.key}" < {b}') for a, b in zip(ends, ends[1:])], _Range(f'"{self.key}" >= {ends[-1]}')]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with connect(self.url) as db:
            yield from db.execute(f'SELECT {self.columns} FROM "{self.table}" WHERE {partition.where}')


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.url = options["url"]
        self.statement = f'INSERT OR IGNORE INTO "{options["dbtable"]}" ({", ".join(f""" "{c}" """.strip() for c in columns)}) VALUES ({", ".join("?" * len(columns))})'

    def write(self, rows: Iterator[tuple]) -> WriterCommitMessage:
        """A task is a transaction; a task that runs again finds its keys."""
        with connect(self.url) as db:
            db.execute("BEGIN IMMEDIATE")
            db.executemany(self.statement, (tuple(r) for r in rows))
            db.execute("COMMIT")
        return WriterCommitMessage()


class Sqlite(DataSource):
    """Options: url, dbtable, and for reading key and partitions."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_sqlite"

    def schema(self) -> str:
        named = {v: k for k, v in _TYPES.items()}
        with connect(self.options["url"]) as db:
            found = db.execute(f'PRAGMA table_info("{self.options["dbtable"]}")').fetchall()
        return ", ".join(f"`{c[1]}` {named[c[2].lower()]}" for c in found)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema.names)


def scan(spark: SparkSession, url: str, table: str, key: str, partitions: int) -> DataFrame:
    spark.dataSource.register(Sqlite)
    return spark.read.format(Sqlite.name()).options(url=url, dbtable=table, key=key, partitions=str(partitions)).load()


def append(rows: DataFrame, url: str, table: str, key: str) -> None:
    """``rows`` into a table, which is made if it isn't there; its key is unique."""
    if other := {k for _, k in rows.dtypes} - set(_TYPES):
        raise ValueError(f"no such types in the file: {', '.join(sorted(other))}")
    columns = ", ".join(f'"{c}" {_TYPES[k]}{" PRIMARY KEY" if c == key else ""}' for c, k in rows.dtypes)
    with connect(url) as db:
        db.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({columns})')
    rows.sparkSession.dataSource.register(Sqlite)
    rows.write.format(Sqlite.name()).options(url=url, dbtable=table).mode("append").save()
