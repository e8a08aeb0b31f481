"""Queries over databases, closed extracts, ingestion summaries, answers and word pieces, and their SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import expr, wordpiece
from tidemark.operators import closure, evidence, ingest
from tidemark.plans import catalog
from tidemark.plans import surrogate as S
from tidemark.sources import jdbc, sqlite
from tidemark.sources.storage import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = function, sql
        return function

    return add


# ---- answers and word pieces -----------------------------------------------

# Answers of five kinds, and the object in each, with the event's number for N.
_ANSWERS = [
    ("Sure: {\"id\": N, \"s\": \"}{\"} and {", "{\"id\": N, \"s\": \"}{\"}"),
    ("```json\n{\"id\": N}\n```", "{\"id\": N}"),
    ("  no object N ", "no object N"),
    ("{\"a\": \"\\\\\\\"}\", \"b\": {\"id\": N}}} tail", "{\"a\": \"\\\\\\\"}\", \"b\": {\"id\": N}}"),
    ("open {\"id\": N, \"q\": \"never closed }", "{\"id\": N, \"q\": \"never closed }"),
]


def _kinds_sql(which: int) -> str:
    cases = " ".join(f"WHEN {k} THEN '" + x[which].replace("\n", "' || chr(10) || '") + "'" for k, x in enumerate(_ANSWERS))
    return f"replace(CASE event_id % {len(_ANSWERS)} {cases} END, 'N', event_id::VARCHAR)"


@query("x12_json_objects", f"SELECT event_id AS id, {_kinds_sql(1)} AS object FROM events")
def x12(spark, sf):
    """Also R02: objects out of prose, fences and quotes."""
    kind = F.get(F.array(*[F.lit(a) for a, _ in _ANSWERS]), (F.col("event_id") % len(_ANSWERS)).cast("int"))
    rows = S.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.replace(kind, F.lit("N"), F.col("event_id").cast("string")).alias("answer"))
    return rows.select("id", expr.first_json(F.col("answer")).alias("object"))


#: Words of a vocabulary besides the letters.
_WORDS = 500


@query(
    "x19_word_pieces",
    f"""WITH RECURSIVE t AS (SELECT doc_id, string_split_regex(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g')), ' ') AS w FROM documents),
        e AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t) WHERE w[i] <> ''),
        top AS (SELECT word FROM e WHERE length(word) <= 8 GROUP BY word ORDER BY count(*) DESC, word LIMIT {_WORDS}),
        parts AS (SELECT word FROM top UNION SELECT chr(CAST(96 + k AS INTEGER)) FROM (SELECT unnest(range(1, 27)) AS k)),
        named AS (SELECT word AS piece FROM parts UNION ALL SELECT '##' || word FROM parts),
        vocabulary AS (SELECT piece, row_number() OVER (ORDER BY piece) + 2 AS id FROM named),
        words AS (SELECT DISTINCT word FROM e),
        run AS (
            SELECT word, 1 AS pos, CAST([] AS BIGINT[]) AS ids FROM words
            UNION ALL
            SELECT r.word, r.pos + max(s.size), list_append(r.ids, arg_max(v.id, s.size))
            FROM run r, (SELECT unnest(range(1, 9)) AS size) s, vocabulary v
            WHERE r.pos + s.size <= length(r.word) + 1 AND v.piece = CASE WHEN r.pos > 1 THEN '##' ELSE '' END || substr(r.word, r.pos, s.size)
            GROUP BY r.word, r.pos, r.ids),
        cut AS (SELECT word, CASE WHEN length(word) > 100 THEN [0] ELSE ids END AS ids FROM run WHERE pos = length(word) + 1),
        d AS (SELECT doc_id, flatten(list(ids ORDER BY i)) AS ids FROM e JOIN cut USING (word) GROUP BY doc_id)
        SELECT doc_id, CAST(least(coalesce(len(ids), 0), 510) + 2 AS BIGINT) AS n_ids,
               md5('1,' || CASE WHEN ids IS NULL THEN '' ELSE array_to_string(ids[1:510], ',') || ',' END || '2') AS ids_md5
        FROM documents LEFT JOIN d USING (doc_id)""",
)
def x19(spark, sf):
    """The vocabulary has the letters and the most frequent short words, whole and as continuations; the cap of 512 is the format's."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z]+", " "))
    docs = S.table(spark, sf, "documents").select("doc_id", plain.alias("text"))
    words = docs.select(F.explode(F.split("text", " ")).alias("word")).where("length(word) between 1 and 8")
    top = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(_WORDS)
    parts = {r["word"] for r in top.select("word").collect()} | set("abcdefghijklmnopqrstuvwxyz")
    vocabulary = {"[UNK]": 0, "[CLS]": 1, "[SEP]": 2}
    vocabulary |= {p: k + 3 for k, p in enumerate(sorted([*parts, *("##" + p for p in parts)]))}
    ids = docs.select("doc_id", wordpiece.encoded(F.col("text"), vocabulary).alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


# ---- extracts and ingestion ------------------------------------------------


@query(
    "c25_closed_extract",
    S.with_(
        *catalog._ALERTS,
        "hit AS (SELECT DISTINCT article_id, company_id FROM news n WHERE EXISTS (SELECT 1 FROM alerts a WHERE a.company_id = n.company_id AND a.day = n.pub_day))",
        "kept AS (SELECT alert_id FROM alerts WHERE company_id % 10 <> 0)",
    )
    + """SELECT 'companies' AS "table", '' AS reference, count(*) AS "rows", 0::BIGINT AS dangling FROM companies WHERE id % 10 <> 0
         UNION ALL SELECT 'news_articles', '', count(DISTINCT article_id), 0 FROM hit
         UNION ALL SELECT 'article_companies', r, count(*), 0 FROM hit, (VALUES ('article_id'), ('company_id')) t(r) WHERE company_id % 10 <> 0 GROUP BY r
         UNION ALL SELECT 'alerts', 'company_id', count(*), 0 FROM kept
         UNION ALL SELECT 'alert_explanations', 'alert_id', count(*), 0 FROM kept WHERE alert_id % 3 = 0""",
)
def c25(spark, sf):
    """What a demonstration needs without a tenth of the companies: no reference of any table hangs."""
    tables = {
        "alert_explanations": catalog.explanations(spark, sf),
        "alerts": catalog.alerts(spark, sf),
        "article_companies": S.links(spark, sf),
        "news_articles": S.articles(spark, sf).withColumn("body", F.lit(None).cast("string")),
        "companies": S.companies(spark, sf),
    }
    part = evidence.demo_extract(tables)
    whole = closure.closed(part, closure.STORED, {"companies": part["companies"].where("id % 10 <> 0")})
    return closure.dangling(whole, closure.STORED)


@query(
    "c26_ingest_status",
    """WITH f AS (SELECT page_id % 50 AS cik, page_id % 7 <> 0 AS there, row_number() OVER (PARTITION BY page_id % 50 ORDER BY page_id % 300 DESC, page_id::VARCHAR DESC) AS r FROM pages),
       q AS (SELECT cik, count(*) AS n, count(*) FILTER (WHERE there) AS stored FROM f WHERE r <= 3 GROUP BY cik),
       c AS (SELECT upper(c_name) AS ticker, c_custkey % 100 AS cik, c_custkey % 3 <> 0 AS known FROM customer)
       SELECT ticker, CASE WHEN NOT known THEN 'not_found' WHEN n IS NULL THEN 'no_10k' ELSE 'ok' END AS status,
              CASE WHEN known THEN coalesce(stored, 0) ELSE 0 END AS filings_stored, CASE WHEN known THEN coalesce(n, 0) ELSE 0 END AS judged
       FROM c LEFT JOIN q USING (cik)""",
)
def c26(spark, sf):
    """A row for each ticker asked for; pages stand for filings, and every seventh couldn't be fetched."""
    names = S.table(spark, sf, "customer").select(F.lower("c_name").alias("ticker"), "c_custkey")
    ciks = names.where("c_custkey % 3 <> 0").select(F.upper("ticker").alias("ticker"), (F.col("c_custkey") % 100).cast("string").alias("cik"))
    page = F.col("page_id")
    filings = S.table(spark, sf, "pages").select(
        (page % 50).cast("string").alias("cik"),
        page.cast("string").alias("accession_number"),
        F.expr("date '2020-01-01' + cast(page_id % 300 as int)").alias("filed_date"),
        F.when(page % 7 != 0, F.col("html")).alias("html"),
    )
    found = ingest.ticker_summaries(names.select("ticker").unionByName(names.select("ticker")), ciks, filings)
    return found.select("ticker", "status", "filings_stored", F.coalesce(F.size("quality"), F.lit(0)).cast("long").alias("judged"))


# ---- databases -------------------------------------------------------------

_REFERS: closure.References = {"nation": {"n_regionkey": ("region", "r_regionkey")}, "supplier": {"s_nationkey": ("nation", "n_nationkey")}, "customer": {"c_nationkey": ("nation", "n_nationkey")}}
_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey"}


def database(spark: SparkSession) -> str:
    """A database of this process; where executors are other processes, a file in the shared folder."""
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        scheme, _, path = scratch_path(spark).rpartition(":")
        if scheme not in ("", "file"):
            raise ValueError("a database in a file needs a spark.checkpoint.dir that is mounted on all machines")
        path = "/" + path.lstrip("/")
        os.makedirs(path)
        return f"{sqlite.PREFIX}{path}/tables.db"
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    return f"jdbc:derby:memory:tidemark{uuid.uuid4().hex};create=true"


@query("k15_jdbc_copy", "SELECT c_custkey, c_name, c_mktsegment, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def k15(spark, sf):
    """A copy that stopped within a table and is begun again, read back."""
    url = database(spark)
    tables = {
        "customer": S.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"),
        "nation": S.table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"),
        "region": S.table(spark, sf, "region").select("r_regionkey", "r_name"),
    }
    jdbc.copy(tables | {"customer": tables["customer"].where("c_custkey % 3 = 0")}, _KEYS, _REFERS, url)
    for _ in range(2):
        jdbc.copy(tables, _KEYS, _REFERS, url)
    read = {name: jdbc.scan(spark, url, name, _KEYS[name], 4) for name in tables}
    joined = read["customer"].join(read["nation"], F.col("n_nationkey") == F.col("c_nationkey")).join(read["region"], F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.select("c_custkey", "c_name", "c_mktsegment", "n_name", "r_name")


@query("s01_jdbc_scan", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 1 AND s_nationkey > 5")
def s01(spark, sf):
    """Also S17: columns and filters go to the database."""
    url = database(spark)
    rows = {"supplier": S.table(spark, sf, "supplier").where("s_suppkey % 2 = 1").select("s_suppkey", "s_name", "s_nationkey")}
    jdbc.copy(rows, _KEYS, {}, url)
    return jdbc.scan(spark, url, "supplier", "s_suppkey", 4).where("s_nationkey > 5").select("s_suppkey", "s_name")
