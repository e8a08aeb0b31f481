"""More queries with their SQL: scans and sinks through files, row functions, gates and reports."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import expr, stats
from tidemark.operators import ingest, modelops, panel, validate
from tidemark.plans import surrogate as S
from tidemark.sources import readers, schemas, writers
from tidemark.sources.storage import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = datetime.datetime(2024, 1, 15)


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = function, sql
        return function

    return add


# ---- scans -----------------------------------------------------------------


def bars(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.prices(spark, sf).select("ticker", F.col("day").alias("date"), "open", "high", "low", "close", F.col("close").alias("adj_close"), "volume")
    return rows


_BARS = "SELECT ticker, day AS date, open, high, low, close, close AS adj_close, volume FROM prices"


def through_csv(spark: SparkSession, df: DataFrame, **options: object) -> str:
    path = scratch_path(spark)
    df.write.options(header=True, **options).csv(path)
    return path


@query("s02_price_csv", S.with_(S.PRICES) + _BARS)
def s02(spark, sf):
    return readers.price_csv(spark, through_csv(spark, bars(spark, sf)))


@query("s03_news_csv", S.with_(S.NEWS) + "SELECT ticker, pub_day AS date, count(*)::INTEGER AS news_n, round(avg(neg), 9) AS news_neg, round(avg(CASE WHEN label = 'negative' THEN 1.0 ELSE 0.0 END), 9) AS neg_ratio FROM news GROUP BY ALL")
def s03(spark, sf):
    negative = F.when(F.col("label") == "negative", 1.0).otherwise(0.0)
    days = S.news(spark, sf).groupBy("ticker", F.to_date("published_at").alias("date")).agg(
        F.count("*").alias("news_n"), F.round(F.avg("neg"), 9).alias("news_neg"), F.round(F.avg(negative), 9).alias("neg_ratio")
    )
    return readers.news_csv(spark, through_csv(spark, days))


@query("s04_constituents_csv", "SELECT upper(c_name) AS ticker, c_name AS name, c_mktsegment AS sector, lpad(c_custkey::VARCHAR, 10, '0') AS cik FROM customer WHERE c_custkey % 10 <> 0")
def s04(spark, sf):
    raw = S.companies(spark, sf).select(
        F.when(F.col("id") % 10 != 0, F.concat(F.lit(" "), F.lower("ticker"))).alias("Symbol"), F.col("name").alias("Security"), F.col("sector").alias("Sector"), F.col("id").cast("string").alias("CIK")
    )
    return readers.constituents(readers.csv(spark, through_csv(spark, raw, ignoreLeadingWhiteSpace=False), schemas.CONSTITUENTS_CSV))


_SECTORS = {"Customer#000000002": "Financials", "Customer#000000001": "Energy", "Customer#000000005": "Health Care"}


@query(
    "s05_sector_table",
    "SELECT c_name AS ticker, CASE c_name "
    + " ".join(f"WHEN '{t}' THEN '{x}'" for t, x in _SECTORS.items())
    + " ELSE c_mktsegment END AS sector FROM customer",
)
def s05(spark, sf):
    """The sectors of a literal table for the companies that it knows."""
    known = readers.sector_table(spark, _SECTORS).withColumnRenamed("sector", "known")
    rows = S.companies(spark, sf).join(F.broadcast(known), "ticker", "left")
    return rows.select("ticker", F.coalesce("known", "sector").alias("sector"))


@query("s06_cik_map", "SELECT upper(c_name) AS ticker, lpad(c_custkey::VARCHAR, 10, '0') AS cik FROM customer")
def s06(spark, sf):
    """Objects of fifty entries each."""
    entry = F.struct(F.col("id").cast("string").alias("key"), F.struct(F.col("id").cast("string").alias("cik_str"), F.lower("name").alias("ticker"), F.col("name").alias("title")).alias("value"))
    each = S.companies(spark, sf).groupBy(F.expr("id div 50")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).select("value")
    path = scratch_path(spark)
    each.write.text(path)
    return readers.ticker_to_cik(spark.read.text(path))


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    """Histories of companies as parallel arrays, written and read as JSON; some forms end with a hard space."""
    form = F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 2 == 0, "10-K").otherwise("10-K\u00a0")).otherwise("8-K")
    one = F.struct(F.col("o_orderkey"), form.alias("form"), F.col("o_orderkey").cast("string").alias("accessionNumber"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filingDate"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("primaryDocument"))
    lists = S.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("cik")).agg(F.array_sort(F.collect_list(one)).alias("x"))
    path = scratch_path(spark)
    lists.select("cik", *[F.col(f"x.{c}").alias(c) for c in ("form", "accessionNumber", "filingDate", "primaryDocument")]).write.json(path)
    kind = "cik string, form array<string>, accessionNumber array<string>, filingDate array<string>, primaryDocument array<string>"
    return spark.read.schema(kind).json(path)


@query(
    "s07_submission_history",
    "SELECT o_custkey::VARCHAR AS cik, '10-K' AS form_type, o_orderkey::VARCHAR AS accession_number, CAST(o_orderdate AS DATE) AS filed_date, 'd' || o_orderkey AS primary_document FROM orders WHERE o_orderstatus = 'F'",
)
def s07(spark, sf):
    """Also S08 and R01."""
    return readers.filings_of(submissions(spark, sf))


@query(
    "s10_filing_url",
    "SELECT o_orderkey AS id, 'https://www.sec.gov/Archives/edgar/data/' || ltrim(o_custkey::VARCHAR, '0') || '/' || o_orderkey || o_custkey || '/d' || o_orderkey || '.htm' AS url FROM orders",
)
def s10(spark, sf):
    rows = S.table(spark, sf, "orders").select("o_orderkey", *[F.col(c).cast("string").alias(n) for c, n in (("o_orderkey", "k"), ("o_custkey", "c"))])
    url = readers.filing_url(readers.padded_cik(F.col("c")), F.concat_ws("-", "k", "c"), F.concat(F.lit("d"), "k", F.lit(".htm")))
    return rows.select(F.col("o_orderkey").alias("id"), url.alias("url"))


@query("s11_news_feed", "SELECT event_id AS id, props AS url, event_type AS headline, floor(epoch(ts))::BIGINT::VARCHAR AS datetime FROM events WHERE event_id % 7 <> 0")
def s11(spark, sf):
    """Every seventh line is a list, not an object."""
    rows = S.table(spark, sf, "events").select("event_id", F.struct(F.col("event_id").alias("id"), F.col("props").alias("url"), F.col("event_type").alias("headline"), F.col("ts").cast("timestamp").cast("long").cast("string").alias("datetime")).alias("o"))
    path = scratch_path(spark)
    rows.select(F.when(F.col("event_id") % 7 == 0, "not an object").otherwise(F.to_json("o")).alias("value")).write.text(path)
    return readers.feed(spark, path).select("id", "url", "headline", "datetime")


@query("s12_market_symbol", "SELECT p_partkey AS id, replace(replace(p_type, ' ', '.'), '.', '-') AS symbol FROM part")
def s12(spark, sf):
    return S.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), readers.symbol(F.translate("p_type", " ", ".")).alias("symbol"))


@query("s13_clean_bars", S.with_(S.PRICES) + "SELECT ticker, day AS date, open, CASE WHEN volume % 2 = 0 THEN high END AS high, low, close, CASE WHEN volume % 3 = 0 THEN close ELSE open END AS adj_close FROM prices")
def s13(spark, sf):
    rows = S.prices(spark, sf).withColumn("high", F.when(F.col("volume") % 2 == 0, F.col("high")).otherwise(float("nan")))
    rows = rows.withColumn("adj_close", F.when(F.col("volume") % 3 != 0, F.col("open")).when(F.col("volume") % 2 == 0, float("nan")))
    return readers.clean_bars(rows).select("ticker", F.col("day").alias("date"), "open", "high", "low", "close", "adj_close")


@query("s14_unprocessed", "SELECT event_id AS id FROM events WHERE event_id % 3 <> 1")
def s14(spark, sf):
    done = F.when(F.col("event_id") % 3 == 1, True).when(F.col("event_id") % 3 == 2, False)
    return readers.unprocessed(S.table(spark, sf, "events").select(F.col("event_id").alias("id"), done.alias("processed"))).select("id")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Parity objects of the benchmark's items, ten each: ids are the item's number, logits what it makes of it."""
    k = F.col("item_id")
    logits = F.array((k % 7).cast("float"), (k % 5).cast("float"), (k % 3).cast("float"))
    one = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.array(k, k + 1).alias("input_ids"), F.array(F.lit(1).cast("long")).alias("attention_mask"), F.array(F.lit(0).cast("long")).alias("token_type_ids"), logits.alias("logits"), F.create_map(F.lit("negative"), F.lit(0.5)).alias("probs"))
    path = scratch_path(spark)
    S.table(spark, sf, "benchmark").groupBy(F.expr("item_id div 10")).agg(F.collect_list(one).alias("samples")).select("samples").write.json(path)
    return readers.parity_samples(spark, path, multi_line=False)


@query("s15_parity_samples", "SELECT coalesce(text, '') AS text, item_id AS first_id, (item_id % 7)::DOUBLE AS logit, 0.5::DOUBLE AS negative FROM benchmark")
def s15(spark, sf):
    return samples(spark, sf).select("text", F.col("input_ids")[0].alias("first_id"), F.col("logits")[0].cast("double").alias("logit"), F.element_at("probs", "negative").alias("negative"))


# ---- sinks -----------------------------------------------------------------


@query(
    "k02_filing_upsert",
    """WITH t AS (SELECT props AS a, event_id AS seq, event_type AS f, value::VARCHAR AS r FROM events),
       old AS (SELECT a, arg_min(f, seq) AS f, arg_min(r, seq) AS r FROM t WHERE seq % 2 = 0 GROUP BY a),
       new AS (SELECT a, arg_min(f, seq) AS nf, arg_max(r, seq) AS nr FROM t WHERE seq % 2 = 1 GROUP BY a)
       SELECT a AS accession_number, CASE WHEN old.a IS NOT NULL THEN f ELSE nf END AS form_type, round(coalesce(nr, r)::DOUBLE, 6) AS raw_text FROM old FULL JOIN new USING (a)""",
)
def k02(spark, sf):
    rows = S.table(spark, sf, "events").select(F.col("props").alias("accession_number"), F.col("event_id").alias("seq"), F.col("event_type").alias("form_type"), F.col("value").cast("string").alias("raw_text"))
    old = rows.where("seq % 2 = 0").groupBy("accession_number").agg(F.min_by("form_type", "seq").alias("form_type"), F.min_by("raw_text", "seq").alias("raw_text"))
    return writers.upsert_filings(old, rows.where("seq % 2 = 1")).withColumn("raw_text", F.round(F.col("raw_text").cast("double"), 6))


@query(
    "k06_explanation_upsert",
    """WITH t AS (SELECT user_id AS alert_id, event_id AS seq, event_type AS status FROM events),
       l AS (SELECT alert_id, max((seq % 2) * 100000000 + seq) AS top, arg_max(status, (seq % 2) * 100000000 + seq) AS status, arg_max(seq, (seq % 2) * 100000000 + seq) AS seq FROM t GROUP BY 1)
       SELECT alert_id, status, CASE WHEN top >= 100000000 AND seq % 5 = 0 THEN 0 ELSE 1 END AS n_cited FROM l""",
)
def k06(spark, sf):
    rows = S.table(spark, sf, "events").select(F.col("user_id").alias("alert_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    old = rows.where("seq % 2 = 0").groupBy("alert_id").agg(F.max_by("status", "seq").alias("status")).withColumn("cited_ids", F.array(F.lit(7)))
    new = rows.where("seq % 2 = 1").withColumn("cited_ids", F.when(F.col("seq") % 5 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(8))))
    out = writers.upsert_explanations(old, new)
    return out.select("alert_id", "status", F.coalesce(F.size("cited_ids"), F.lit(0)).alias("n_cited"))


@query("k07_replaced_partition", "SELECT event_id AS id, event_type AS alert_type, CASE WHEN event_type = 'click' THEN value + 1 ELSE value END AS score FROM events WHERE event_type <> 'click' OR event_id % 2 = 0")
def k07(spark, sf):
    rows = S.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("value").alias("score"), F.col("event_type").alias("alert_type"))
    path = scratch_path(spark)
    rows.write.partitionBy("alert_type").parquet(path)
    writers.replace_partition(rows.where("alert_type = 'click' and id % 2 = 0").withColumn("score", F.col("score") + 1), path, "alert_type")
    return spark.read.schema(rows.schema).parquet(path)


@query("k08_rebuilt_table", "SELECT doc_id, quality FROM labels WHERE quality = 1")
def k08(spark, sf):
    rows = S.table(spark, sf, "labels").select("doc_id", "quality")
    path = scratch_path(spark)
    writers.rebuild(rows, path)
    writers.rebuild(rows.where("quality = 1"), path)
    return spark.read.parquet(path)


@query(
    "k09_touched_key",
    """SELECT c_custkey AS id, c_custkey % 4 <> 0 AND (c_custkey % 3 = 0 OR c_custkey % 3 = 1) AS valid,
       c_custkey = 7 AS used FROM customer""",
)
def k09(spark, sf):
    """Also F16: keys that are not active, or expired, can't be used; one is."""
    k = F.col("id")
    ends = F.when(k % 3 == 1, F.lit(NOW + datetime.timedelta(days=1))).when(k % 3 == 2, F.lit(NOW))
    keys = S.companies(spark, sf).select("id", F.col("ticker").alias("key_hash"), F.when(k % 8 != 0, k % 4 != 0).alias("active"), ends.alias("expires_at"), F.lit(None).cast("timestamp").alias("last_used_at"))
    name = keys.where("id = 7").first()["key_hash"]
    return writers.touch(keys, name, NOW).select("id", writers.valid_key(F.lit(NOW)).alias("valid"), F.col("last_used_at").isNotNull().alias("used"))


@query(
    "k10_prediction_log",
    """SELECT 'v1' AS model_version, '{"text_sha256":"' || sha256(text) || '","token_count":' || item_id || '}' AS input_features, 0.25::DOUBLE AS output_score,
       0.5::DOUBLE AS confidence, '{"negative":0.25,"positive":0.5}' AS feature_contributions FROM benchmark WHERE text IS NOT NULL""",
)
def k10(spark, sf):
    """Also R04, R05 and R09."""
    probs = expr.label_map(F.array(F.lit("negative"), F.lit("positive")), F.array(F.lit(0.25), F.lit(0.5)))
    rows = S.table(spark, sf, "benchmark").where("text is not null").select("text", F.col("item_id").alias("n_tokens"), probs.alias("probs"), F.lit(1.0).alias("runtime_ms"))
    return writers.prediction_log(rows, "v1", "onnx").drop("runtime_ms", "inference_backend")


@query("k12_csv_export", S.with_(S.LONG) + "SELECT ticker, date, round_even(close::DECIMAL(18, 6), 2)::DOUBLE AS close FROM bars")
def k12(spark, sf):
    """Also K13: rounded half to even."""
    path = scratch_path(spark)
    writers.export_csv(S.long_prices(spark, sf), path, ["ticker", "date"], {"close": 2})
    return readers.csv(spark, path, "ticker string, date date, close double")


@query(
    "k14_sql_dump",
    """WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name || '''s' END AS name, c_custkey % 2 = 0 AS even FROM customer)
       SELECT 'INSERT INTO companies (id, name, even, cited) VALUES (' || c_custkey || ', ' || CASE WHEN name IS NULL THEN 'NULL' ELSE '''' || replace(name, '''', '''''') || '''' END
              || CASE WHEN even THEN ', TRUE, ' ELSE ', FALSE, ' END || '''{' || c_custkey || ',1}'') ON CONFLICT DO NOTHING;' AS statement FROM r
       UNION ALL SELECT 'SELECT setval(pg_get_serial_sequence(''companies'', ''id''), COALESCE((SELECT MAX(id) FROM companies), 1));'""",
)
def k14(spark, sf):
    """Also X20: written by the tasks as text files, and read back."""
    name = F.when(F.col("id") % 7 != 0, F.concat("name", F.lit("'s")))
    rows = S.companies(spark, sf).select("id", name.alias("name"), (F.col("id") % 2 == 0).alias("even"), F.array("id", F.lit(1)).alias("cited"))
    folders = writers.sql_dump_files([("companies", rows)], scratch_path(spark))
    return spark.read.text(folders).withColumnRenamed("value", "statement")


# ---- filters, joins, reports -----------------------------------------------


@query(
    "j02_risk_dataset",
    S.with_(S.FILINGS)
    + """SELECT filing_id, ticker, 'Unknown' AS sector, n_sentences, round(mean_negative, 9) AS mean_negative FROM filings WHERE filing_id % 2 = 0 AND filing_id % 3 <> 0""",
)
def j02(spark, sf):
    """Also F02 and F18: one model's scores of labelled filings; sectors are not known."""
    rows = S.filings(spark, sf)
    names = rows.select("ticker").distinct().withColumn("id", F.xxhash64("ticker")).withColumn("sector", F.lit(None).cast("string"))
    made = F.struct(*[F.col(c) if c in rows.columns else F.lit(0.0).alias(c) for c in ("n_sentences", *validate.FEATURES)])
    version = F.when(F.col("filing_id") % 2 == 0, "v1").otherwise("v2")
    scores = rows.select("filing_id", version.alias("model_version"), made.alias("signal_breakdown"))
    labels = rows.select("filing_id", F.when(F.col("filing_id") % 3 != 0, 0.1).alias("realized_vol"), F.lit("low").alias("vol_label"))
    filed = rows.select(F.col("filing_id").alias("id"), F.xxhash64("ticker").alias("company_id"), "filed_date")
    out = validate.load_dataset(scores, filed, labels, names, "v1")
    return out.select("filing_id", "ticker", "sector", "n_sentences", F.round("mean_negative", 9).alias("mean_negative"))


@query("f06_financials", "SELECT c_custkey AS id, c_custkey % 3 = 0 AS financial FROM customer")
def f06(spark, sf):
    sector = F.when(F.col("id") % 3 == 0, "Regional FINANCIALS").when(F.col("id") % 3 == 1, "Energy")
    return S.companies(spark, sf).select("id", expr.is_financial(sector).alias("financial"))


def raw_feed(spark: SparkSession, sf: str) -> DataFrame:
    """A feed with blank urls and headlines, and times that are none."""
    k = F.col("event_id")
    return S.table(spark, sf, "events").select(
        F.concat(F.lit("CUSTOMER#"), F.col("user_id").cast("string")).alias("ticker"),
        k.alias("seq"),
        F.when(k % 11 == 0, "  ").otherwise(F.col("props")).alias("url"),
        F.when(k % 13 != 0, F.concat(F.lit(" "), "event_type")).alias("headline"),
        F.when(k % 2 == 0, " ").otherwise("body").alias("summary"),
        F.when(k % 5 == 0, "").otherwise("wire").alias("source"),
        F.when(k % 3 == 0, "0").when(k % 3 == 1, "no time").otherwise((k + 1000).cast("string")).alias("datetime"),
    )


_FEED = """feed AS (
    SELECT event_id AS seq, 'CUSTOMER#' || user_id AS ticker, user_id, props AS url, event_type AS headline, CASE WHEN event_id % 2 <> 0 THEN 'body' END AS body,
           CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE 'wire' END AS source, CASE WHEN event_id % 3 = 2 THEN event_id + 1000 END AS epoch
    FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0)"""


@query("f15_usable_articles", S.with_(_FEED) + "SELECT seq, url, headline, body, source, epoch FROM feed")
def f15(spark, sf):
    """Also D02."""
    rows = ingest.normalise_articles(raw_feed(spark, sf))
    return rows.select("seq", "url", "headline", "body", "source", F.col("published_at").cast("long").alias("epoch"))


@query(
    "c27_stored_news",
    S.with_(_FEED) + "SELECT url, arg_max(headline, seq) AS headline, arg_min(source, seq) AS source, count(DISTINCT ticker) AS companies FROM feed GROUP BY url",
)
def c27(spark, sf):
    names = S.table(spark, sf, "events").select(F.col("user_id").alias("id"), F.concat(F.lit("CUSTOMER#"), F.col("user_id").cast("string")).alias("ticker")).distinct()
    articles, links = ingest.store_news(raw_feed(spark, sf), names)
    return articles.join(links.groupBy("url").agg(F.count("*").alias("companies")), "url").select("url", "headline", "source", "companies")


@query("j12_price_history", S.with_(S.PRICES) + "SELECT ticker, day AS date, open, high, low, close, volume FROM prices WHERE company_id % 2 = 0")
def j12(spark, sf):
    stored = S.prices(spark, sf).select("company_id", F.col("day").alias("date"), "open", "high", "low", "close", "volume")
    return panel.price_history(stored, S.companies(spark, sf).where("id % 2 = 0"))


@query("a10_price_span", S.with_(S.PRICES) + "SELECT count(*) AS n, count(DISTINCT ticker) AS companies, min(day) AS first_day, max(day) AS last_day FROM prices")
def a10(spark, sf):
    return panel.span(S.prices(spark, sf))


@query("t04_sorted_bars", S.with_(S.LONG) + "SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date)::INTEGER AS place FROM bars")
def t04(spark, sf):
    from pyspark.sql import Window

    return S.long_prices(spark, sf).withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy("date")))


@query("u01_union_of_tickers", S.with_(S.LONG) + "SELECT ticker, count(*) AS n FROM bars WHERE ticker IN ('BUILDING', 'MACHINERY') GROUP BY ticker")
def u01(spark, sf):
    rows = S.long_prices(spark, sf)
    return rows.where("ticker = 'BUILDING'").unionByName(rows.where("ticker = 'MACHINERY'")).groupBy("ticker").agg(F.count("*").alias("n"))


@query(
    "a14_quality_report",
    """WITH r AS (SELECT CASE event_id % 4 WHEN 0 THEN 'not_found' WHEN 1 THEN 'incorporated_by_reference' ELSE 'extracted' END AS s, event_id % 6 = 2 AS f FROM events)
       SELECT count(*) AS total, count(*) FILTER (WHERE s = 'extracted') AS extracted, count(*) FILTER (WHERE s = 'incorporated_by_reference') AS incorporated_by_reference,
              count(*) FILTER (WHERE s = 'not_found') AS not_found, count(*) FILTER (WHERE s = 'extracted' AND f) AS flagged,
              round((count(*) FILTER (WHERE s = 'extracted' AND NOT f)) / count(*)::DOUBLE, 9) AS usable_rate FROM r""",
)
def a14(spark, sf):
    k = F.col("event_id")
    status = F.when(k % 4 == 0, "not_found").when(k % 4 == 1, "incorporated_by_reference").otherwise("extracted")
    flags = F.when(k % 6 == 2, F.array(F.lit("short"))).otherwise(F.array().cast("array<string>"))
    out = ingest.quality_report(S.table(spark, sf, "events").select(status.alias("status"), flags.alias("flags")))
    return out.withColumn("usable_rate", F.round("usable_rate", 9))


# ---- gates -----------------------------------------------------------------


@query(
    "c22_parity_rows",
    """SELECT left(coalesce(text, ''), 60) AS text, item_id % 10 <> 0 AS ids_match, CASE WHEN item_id % 4 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS max_logit_diff, item_id % 4 <> 0 AS logits_match FROM benchmark""",
)
def c22(spark, sf):
    """Also R06, R07 and X15."""
    return modelops.parity(_ours(spark, sf), "ours", "our_logits")


def _ours(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("input_ids")[0]
    ours = F.when(k % 10 == 0, F.array(k)).otherwise(F.col("input_ids"))
    moved = F.transform("logits", lambda x: (x + F.when(k % 4 == 0, 0.5).otherwise(0.0)).cast("float"))
    return samples(spark, sf).withColumns({"ours": ours, "our_logits": moved})


@query("c22_parity_verdict", "SELECT count(*) AS n, false AS ids_match, 0.5::DOUBLE AS max_logit_diff, false AS logits_match, false AS passed FROM benchmark")
def c22_verdict(spark, sf):
    return modelops.parity_verdict(modelops.parity(_ours(spark, sf), "ours", "our_logits")).drop("diagnosis")


@query("c23_promotion", "SELECT max(event_id)::VARCHAR AS run_id, true AS registered, max(event_id) % 2 = 0 AS alias_moved, (max(event_id) % 2)::INTEGER AS exit_code FROM events")
def c23(spark, sf):
    runs = S.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("run_id"), F.col("event_id").alias("start_time"), (F.col("event_id") % 2 == 0).alias("parity_passed"))
    return modelops.promotion(runs)


@query(
    "c24_quantization_verdict",
    "SELECT flips, flips = 0 AS accepted, CASE WHEN flips = 0 THEN greatest(round_even(2 * shift, 3), 0.05) END AS tolerance FROM (SELECT event_id % 3 AS flips, (event_id % 100) / 1000.0::DOUBLE AS shift FROM events)",
)
def c24(spark, sf):
    metrics = S.table(spark, sf, "events").select((F.col("event_id") % 3).alias("flips"), ((F.col("event_id") % 100) / 1000).alias("max_prob_shift"))
    return modelops.quantization_verdict(metrics).select("flips", "accepted", "tolerance")


# ---- row functions ---------------------------------------------------------


@query("x03_article_text", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE event_type || '. ' || props END AS text FROM events")
def x03(spark, sf):
    body = F.when(F.col("event_id") % 6 == 0, " ").when(F.col("event_id") % 3 != 0, F.col("props"))
    return S.table(spark, sf, "events").select(F.col("event_id").alias("id"), expr.article_text(F.col("event_type"), body).alias("text"))


@query("x15_shortened", "SELECT doc_id, left(text, 60) AS short, left(text, 90) AS longer FROM documents")
def x15(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", expr.shortened(F.col("text"), 60).alias("short"), expr.shortened(F.col("text"), 90).alias("longer"))


@query(
    "x17_citation_parts",
    "SELECT event_id AS id, 'text,cite,text' AS kinds, '[id=' || event_id || ']' AS cited, 'told ' AS start FROM events",
)
def x17(spark, sf):
    parts = expr.citation_parts(F.format_string("told [id=%d] of it", "event_id"))
    rows = S.table(spark, sf, "events").select(F.col("event_id").alias("id"), parts.alias("p"))
    return rows.select("id", F.array_join("p.kind", ",").alias("kinds"), F.col("p")[1]["part"].alias("cited"), F.col("p")[0]["part"].alias("start"))


@query("d02_epoch", "SELECT event_id AS id, CASE WHEN event_id % 2 = 1 AND event_id <> 0 THEN to_timestamp(event_id)::TIMESTAMP END AS at FROM events")
def d02(spark, sf):
    told = F.when(F.col("event_id") % 2 == 1, F.col("event_id").cast("string")).when(F.col("event_id") % 4 == 0, "0").otherwise("n/a")
    return S.table(spark, sf, "events").select(F.col("event_id").alias("id"), expr.from_epoch(told).cast("timestamp_ntz").alias("at"))


@query("d03_parsed_day", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def d03(spark, sf):
    told = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("not a day")
    return S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), expr.parsed_day(told).alias("day"))


@query("d06_expiry", "SELECT event_id AS id, ts + INTERVAL 3600 SECOND AS expires_at, ts + INTERVAL 3600 SECOND > TIMESTAMP '2024-01-15' AS valid FROM events")
def d06(spark, sf):
    ends = expr.expires(F.col("ts"), 3600)
    return S.table(spark, sf, "events").select(F.col("event_id").alias("id"), ends.alias("expires_at"), (ends > F.lit(NOW).cast("timestamp_ntz")).alias("valid"))


@query("m17_clamp", "SELECT event_id AS id, least(greatest(value, 10.0), 50.0) AS value FROM events")
def m17(spark, sf):
    return S.table(spark, sf, "events").select(F.col("event_id").alias("id"), expr.clamp(F.col("value"), 10.0, 50.0).alias("value"))


@query("m07_normal_grid", "SELECT event_id AS k, (event_id % 9999 + 1) / 10000.0::DOUBLE AS p, round((event_id % 9999 + 1) / 10000.0::DOUBLE, 8) AS back FROM events")
def m07(spark, sf):
    """To deviates and back; the tests hold both against literal values."""
    c = stats.columns()
    rows = S.table(spark, sf, "events").select(F.col("event_id").alias("k"), ((F.col("event_id") % 9999 + 1) / 10000).alias("p"))
    return rows.select("k", "p", F.round(c["normal_cdf"](c["inverse_normal_cdf"]("p")), 8).alias("back"))


@query("r10_int_lists", "SELECT event_id AS id, '{' || event_id || ',' || user_id || '}' AS literal, [event_id, user_id]::VARCHAR AS back FROM events")
def r10(spark, sf):
    """Lists of numbers as literals, and read back."""
    literal = F.concat(F.lit("{"), F.concat_ws(",", F.col("event_id").cast("string"), F.col("user_id").cast("string")), F.lit("}"))
    back = F.split(F.regexp_replace(literal, "[{}]", ""), ",").cast("array<bigint>")
    return S.table(spark, sf, "events").select(F.col("event_id").alias("id"), literal.alias("literal"), F.concat(F.lit("["), F.array_join(back.cast("array<string>"), ", "), F.lit("]")).alias("back"))
