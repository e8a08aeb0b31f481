"""Queries that run as streams, in several triggers, and the SQL over the whole tables that must give the same rows.

Streams read files that Spark writes from the given tables, so that they come in
parts; sinks are tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import limits
from tidemark.plans import surrogate as S
from tidemark.sources import storage
from tidemark.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Files that a table is fed in.
PARTS = 4


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = function, sql
        return function

    return add


def fed(rows: DataFrame, part: str, parts: list[int], path: str) -> str:
    """``rows`` added to ``path`` part after part, by the number in column ``part``."""
    for k in parts:
        rows.where(F.col(part) == k).drop(part).write.mode("append").parquet(path)
    return path


def ran(out: DataFrame) -> DataFrame:
    """What a stream appends until there is no more, from a table of the shared folder."""
    path, spark = storage.scratch_path(out.sparkSession), out.sparkSession
    stream_out = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", storage.scratch_path(spark))
    stream_out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


# ---- limiters --------------------------------------------------------------


def admitted_sql(source: str, limit: int, seconds: int) -> str:
    """Each key's requests one after another, with the times of those allowed as a list."""
    window = seconds * limits.SECOND
    return f"""WITH RECURSIVE requests AS ({source}),
        numbered AS (
            SELECT key, id, epoch_us(ts) AS us, dense_rank() OVER (ORDER BY key NULLS FIRST) AS g,
                   row_number() OVER (PARTITION BY key ORDER BY ts, id) AS k FROM requests WHERE ts IS NOT NULL),
        run AS (
            SELECT g, k, key, id, [us] AS hits, true AS allowed, CAST(NULL AS INTEGER) AS retry_after FROM numbered WHERE k = 1
            UNION ALL
            SELECT g, k, key, id, CASE WHEN len(live) < {limit} THEN list_append(live, us) ELSE live END, len(live) < {limit},
                   CASE WHEN len(live) >= {limit} THEN CAST(greatest(1, ceil((live[1] + {window} - us) / {limits.SECOND}.0)) AS INTEGER) END
            FROM (
                SELECT n.*, [h FOR h IN r.hits IF h > n.us - {window}] AS live
                FROM run r JOIN numbered n ON n.g = r.g AND n.k = r.k + 1))
        SELECT coalesce(CAST(key AS VARCHAR), 'none') AS key, id, allowed, coalesce(retry_after, 0) AS retry_after FROM run"""


def shown(decisions: DataFrame) -> DataFrame:
    """Keys as text and no wait as 0, which stay what they are in any client."""
    key = F.coalesce(F.col("key").cast("string"), F.lit("none")).alias("key")
    return decisions.where("id >= 0").select(key, "id", "allowed", F.coalesce("retry_after", F.lit(0)).alias("retry_after"))


#: Every eleventh user is not known; numbers of others are too large for doubles.
_KEY = "CASE WHEN user_id % 11 = 0 THEN NULL ELSE 9007199254740992 + user_id END"


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "events").select(F.expr(_KEY).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))


def request_stream(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` in parts that overlap by hours, and one much later request, which closes all that wait."""
    span = rows.agg(F.min("ts").alias("least"), F.max("ts").alias("most")).first()
    shaken = F.col("ts").cast("double") + F.pmod(F.xxhash64("id"), F.lit(6 * 3600))
    start, end = (span["least"].timestamp(), span["most"].timestamp() + 6 * 3600) if span["least"] else (0.0, 1.0)
    part = F.floor((shaken - start) * PARTS / (end - start)).cast("int")
    path = fed(rows.withColumn("part", F.least(part, F.lit(PARTS - 1))), "part", list(range(PARTS)), storage.scratch_path(spark))
    last = rows.agg((F.max("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts")).where("ts is not null")
    kinds = dict(rows.dtypes)
    last.select(F.lit(None).cast(kinds["key"]).alias("key"), "ts", F.lit(-1).cast(kinds["id"]).alias("id")).write.mode("append").parquet(path)
    return stream.file_stream(spark, path, rows.schema, files_each=8)


@query("st1_streamed_limiter", admitted_sql(f"SELECT {_KEY} AS key, ts, event_id AS id FROM events", 3, 24 * 3600))
def st1_streamed(spark, sf):
    """Also W15: in the order of time, however requests come."""
    source = request_stream(spark, requests(spark, sf))
    return shown(ran(stream.limited(source, limit=3, window=24 * 3600.0, late="12 hours", slot=3600.0)))


@query("st1_limiter_exact_keys", admitted_sql(f"SELECT {_KEY} AS key, ts, event_id AS id FROM events", 2, 3600))
def st1_exact(spark, sf):
    """Null keys and keys that no double holds, under the window of an hour."""
    return shown(limits.admit(requests(spark, sf), limit=2))


@query(
    "st2_named_limiter",
    admitted_sql(
        """SELECT 'mint:' || CASE WHEN user_id % 5 = 0 THEN '10.0.0.' || user_id % 50 WHEN user_id % 5 = 1 THEN 'unknown' ELSE '10.1.0.' || user_id % 20 END AS key,
                  ts, event_id AS id FROM events""",
        5,
        24 * 3600,
    ),
)
def st2(spark, sf):
    """Demo keys asked for: five in 24 hours for each address, the first of those forwarded."""
    user = F.col("user_id")
    forwarded = F.when(user % 5 == 0, F.concat(F.lit(" 10.0.0."), (user % 50).cast("string"), F.lit(" , 192.168.0.1")))
    remote = F.when(user % 5 > 1, F.concat(F.lit("10.1.0."), (user % 20).cast("string")))
    rows = S.table(spark, sf, "events").select(limits.client(forwarded, remote).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
    return shown(ran(stream.limited(request_stream(spark, rows), limit=5, window=24 * 3600.0, late="12 hours", slot=3600.0)))


# ---- ingestion -------------------------------------------------------------

_LISTED = {name: ", ".join(f"'{w}'" for w in words) for name, words in (("positive", X.POSITIVE), ("negative", X.NEGATIVE))}


@query(
    "st3_drained",
    f"""WITH a AS (
            SELECT event_id AS id, regexp_extract_all(lower(event_type || CASE WHEN event_id % 3 = 0 THEN '. loss of growth ' || props ELSE '' END), '[a-z]+') AS w
            FROM events WHERE event_id % 10 <> 0),
        n AS (SELECT id, len([x FOR x IN w IF x IN ({_LISTED["positive"]})]) AS p, len([x FOR x IN w IF x IN ({_LISTED["negative"]})]) AS n, len(w) AS k FROM a),
        s AS (SELECT id, p / (p + n + 1 + k / 20.0) AS p, n / (p + n + 1 + k / 20.0) AS n, 1 - (p + n) / (p + n + 1 + k / 20.0) AS z FROM n)
        SELECT id, CASE WHEN p >= n AND p >= z THEN 'positive' WHEN n >= z THEN 'negative' ELSE 'neutral' END AS sentiment_label,
               round(n, 9) AS sentiment_score, true AS processed FROM s""",
)
def st3(spark, sf):
    """Unprocessed articles, scored once each: the stream stops in the middle, goes on, and its last batch is written again."""
    rows = S.table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("headline"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" loss of growth "), "props")).alias("body"),
        (F.col("event_id") % 10 == 0).alias("processed"),
        F.pmod(F.xxhash64("event_id"), F.lit(PARTS)).cast("int").alias("part"),
    )
    source, sink, at = (storage.scratch_path(spark) for _ in range(3))
    write = stream.numbered(sink)

    def twice(batch: DataFrame, number: int) -> None:
        write(batch, number)
        write(batch, number)  # as after a crash that the checkpoint doesn't know to be over

    for parts in ([0, 1], list(range(2, PARTS))):
        fed(rows, "part", parts, source)
        scored = stream.score_articles(stream.file_stream(spark, source, rows.drop("part").schema, files_each=2))
        stream.drain(scored.select("id", "sentiment_label", "sentiment_score", "processed"), twice, at).awaitTermination()
    kinds = "id long, sentiment_label string, sentiment_score double, processed boolean"
    found = spark.read.schema(kinds).parquet(sink)
    return found.select("id", "sentiment_label", F.round("sentiment_score", 9).alias("sentiment_score"), "processed")


@query("s14_pages", "SELECT event_id AS id, CAST((row_number() OVER (ORDER BY event_id) - 1) // 2000 AS BIGINT) AS page FROM events WHERE event_id % 10 <> 0")
def s14_pages(spark, sf):
    """Unprocessed rows in the order of ids, 2000 a page."""
    rows = S.table(spark, sf, "events").where("event_id % 10 <> 0").select(F.col("event_id").alias("id"))
    return stream.pages(rows, "id").select("id", "page")


@query(
    "st4_reingested",
    """SELECT 'u' || event_id // 4 AS url, arg_max(event_type, event_id) AS headline, arg_min(value, event_id) AS body, CAST(min(event_id) AS BIGINT) AS first_seen
       FROM events GROUP BY 1""",
)
def st4(spark, sf):
    """Articles by url from a feed that is read twice; buckets split as they come, and the table is compacted."""
    rows = S.table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.expr("event_id div 4")).alias("url"),
        F.col("event_type").alias("headline"),
        F.col("value").alias("body"),
        F.col("event_id").alias("first_seen"),
        F.col("event_id").alias("seq"),
    )
    every = rows.agg(F.max("seq").alias("n")).first()["n"] or 0
    part = F.least(F.expr(f"seq * {PARTS} div {every + 1}"), F.lit(PARTS - 1)).cast("int")
    source = fed(rows.withColumn("part", part), "part", list(range(PARTS)), storage.scratch_path(spark))
    table = storage.scratch_path(spark)
    for feed in ("first", "again"):
        write = stream.upserting(table, ["url"], ["headline"], "seq", rows=1000, source=feed)
        stream.drain(stream.file_stream(spark, source, rows.schema, files_each=4), write, storage.scratch_path(spark)).awaitTermination()
    kept = stream.KeyedTable(spark, table, rows.drop("seq").schema, ["url"], rows=1000)
    kept.compact()
    kept.expire()
    return kept.read()


_SHIFTED = "ts + INTERVAL 1 DAY * (user_id % 300)"


@query(
    "st5_streamed_days",
    f"""SELECT c_name AS ticker, CAST(timezone('America/New_York', timezone('UTC', {_SHIFTED})) AS DATE) AS date, count(*) AS news_n,
              round(avg(least(value / 500, 1.0)), 6) AS news_neg, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS neg_ratio
       FROM events JOIN customer ON c_custkey = user_id GROUP BY ALL""",
)
def st5(spark, sf):
    """Also D01: New York's days through both changes of its clocks, each told once it is over."""
    news = S.table(spark, sf, "events").withColumn("published_at", F.col("ts").cast("timestamp") + F.expr("make_dt_interval(cast(user_id % 300 as int))"))
    names = S.companies(spark, sf).select(F.col("id").alias("user_id"), "ticker")
    rows = news.join(names, "user_id").select(
        "ticker",
        "published_at",
        F.least(F.col("value") / 500, F.lit(1.0)).alias("neg"),
        F.when(F.col("event_type") == "error", "negative").otherwise("other").alias("label"),
        F.floor(F.datediff("published_at", F.lit("2024-01-01")) / 100).cast("int").alias("part"),
    )
    path = fed(rows, "part", [0, 1, 2, 3], storage.scratch_path(spark))
    last = rows.agg((F.max("published_at") + F.expr("INTERVAL 1000 DAYS")).alias("published_at")).where("published_at is not null")
    last.select(F.lit("").alias("ticker"), "published_at", F.lit(0.0).alias("neg"), F.lit("").alias("label")).write.mode("append").parquet(path)
    source = stream.file_stream(spark, path, rows.drop("part").schema, files_each=8)
    return ran(stream.daily(source, late="130 days", zone="America/New_York")).where("ticker <> ''")
