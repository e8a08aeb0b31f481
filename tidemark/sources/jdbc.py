"""Partitioned scans of a database, and copies into one that start again where they stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.closure import References, in_order
from tidemark.sources import sqlite


def _options(url: str, options: dict[str, str]) -> dict[str, str]:
    return {"url": url, "pushDownPredicate": "true", "pushDownAggregate": "true", **options}


def scan(spark: SparkSession, url: str, table: str, key: str, partitions: int = 16, **options: str) -> DataFrame:
    """A table in ranges of a whole-number key, each read by a task of its own; filters and columns go to the database.

    The bounds are asked of the database. An empty table, or one whose keys are all null, is read by one task.
    """
    if url.startswith(sqlite.PREFIX):
        return sqlite.scan(spark, url, table, key, partitions)
    base = _options(url, options)
    ends = spark.read.format("jdbc").options(**base).option("query", f'SELECT min("{key}") AS "low", max("{key}") AS "high" FROM {table}').load().first()
    reader = spark.read.format("jdbc").options(**base).option("dbtable", table)
    if ends["low"] is not None and ends["high"] > ends["low"]:
        reader = reader.options(partitionColumn=key, lowerBound=str(ends["low"]), upperBound=str(ends["high"] + 1), numPartitions=str(partitions))
    return reader.load()


def exists(spark: SparkSession, url: str, table: str) -> bool:
    if url.startswith(sqlite.PREFIX):
        return sqlite.exists(url, table)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        found = connection.getMetaData().getTables(None, None, None, None)
        while found.next():
            if found.getString("TABLE_NAME").lower() == table.lower():
                return True
        return False
    finally:
        connection.close()


def copy(tables: dict[str, DataFrame], keys: dict[str, str], references: References, url: str, partitions: int = 4, **options: str) -> dict[str, int]:
    """``tables`` into a database, those referred to first; how many rows each has then.

    Each task's rows are one transaction. A copy that stopped midway is begun
    again in the same way: rows whose key is there already are left out, so none
    is doubled. Keys are unique and not null. Tables that aren't there are made
    with the types of the database's dialect. A url of ``sqlite:`` and a path is
    a file that all executors reach by this path.
    """
    for name in in_order(list(tables), references):
        rows, key = tables[name], keys[name]
        spark = rows.sparkSession
        if exists(spark, url, name):
            there = scan(spark, url, name, key, partitions, **options).select(key)
            rows = rows.join(there, key, "left_anti").select(*rows.columns)
        dealt = rows.repartition(partitions, F.col(key))
        if url.startswith(sqlite.PREFIX):
            sqlite.append(dealt, url, name, key)
            continue
        dealt.write.format("jdbc").options(**_options(url, options)).option("dbtable", name).mode("append").save()
    return {name: scan(rows.sparkSession, url, name, keys[name], partitions, **options).count() for name, rows in tables.items()}
