"""The same operators over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.functions import text as X
from tidemark.sources import storage
from tidemark.streaming.keyed import KeyedTable as KeyedTable
from tidemark.streaming.keyed import current as current
from tidemark.streaming.keyed import upserting as upserting  # ST4
from tidemark.streaming.limiter import limited as limited  # ST1, ST2


def score_articles(articles: DataFrame, scorer: X.Scorer = X.lexicon_scores) -> DataFrame:
    """ST3: articles not processed yet with label and score, as a stream or a table."""
    rows = articles.where(~F.coalesce("processed", F.lit(False))).withColumn("_text", expr.article_text(F.col("headline"), F.col("body")))
    out = X.score_texts(rows, "_text", scorer)
    return out.withColumns({"sentiment_label": F.col("label"), "sentiment_score": F.col("negative"), "processed": F.lit(True)}).drop("_text", "label", "positive", "negative", "neutral")


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """ST3: everything there is, once, in micro-batches; a batch that is run again has the same number."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def numbered(path: str) -> Callable[[DataFrame, int], None]:
    """ST3: a writer for ``drain``: each batch is a folder, and one that is run again replaces its own, so every row is there once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def once(articles: DataFrame, key: str = "url", time: str = "published_at", late: str = "2 days") -> DataFrame:
    """ST4: the first of each key, remembered for ``late``."""
    return articles.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def day_end(ts: Column, zone: str) -> Column:
    """The moment at which the calendar day of a UTC time ends in a zone; days of a change of time have 23 or 25 hours."""
    return F.to_utc_timestamp(F.date_add(expr.local_day(ts, zone), 1).cast("timestamp"), zone)


def daily(news: DataFrame, key: str = "ticker", late: str = "2 days", zone: str = "UTC", time: str = "published_at") -> DataFrame:
    """ST5, D01: features by company and calendar day of ``zone``, each day once it can't change any more.

    A day is closed when a row of a day that ends ``late`` or more after it has
    been seen; rows of closed days that come later go. Rows without a time have
    no day and go.
    """
    rows = news.where(F.col(time).isNotNull()).withColumn("_end", day_end(F.col(time), zone)).withWatermark("_end", late)
    return (
        rows.groupBy("_end", key)
        .agg(
            F.count("*").alias("news_n"),
            F.round(F.avg("neg"), 6).alias("news_neg"),
            F.round(F.avg((F.col("label") == "negative").cast("double")), 6).alias("neg_ratio"),
        )
        .select(key, F.date_sub(expr.local_day(F.col("_end"), zone), 1).alias("date"), "news_n", "news_neg", "neg_ratio")
    )


def file_stream(spark: SparkSession, path: str, schema, files_each: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def pages(table: DataFrame, key: str, size: int = 2000) -> DataFrame:
    """``table`` with ``page``: ``size`` rows each, in the order of a key that is unique and not null.

    Rows are dealt into ranges of the key; a range's first number comes from the
    totals of those before it, so no task orders all rows.
    """
    dealt = storage.checkpoint(table.repartitionByRange(key).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(F.count("*").alias("n"))  # a row for each range
    before = totals.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return dealt.join(F.broadcast(before.drop("n")), "_range").withColumn("page", F.floor((F.col("before") + own) / size)).drop("before", "_range")


def next_page(table: DataFrame, key: str, after: int | None, size: int = 2000) -> DataFrame:
    """The page behind the bookmark ``after``, by its key: the scan skips what is before it."""
    rest = table if after is None else table.where(F.col(key) > after)
    return rest.orderBy(key).limit(size)
