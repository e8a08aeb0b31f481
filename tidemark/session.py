"""The session that plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tidemark", cores: str = "*", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; on a cluster, master and sizes come from spark-submit."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if cores:
        builder = builder.master(f"local[{cores}]")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
