"""Text kernels, the explanation gate, sinks, ingestion, model gates, the forest and streams."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.functions import text as X
from tidemark.operators import anomaly, evidence, explain, ingest, limits, modelops
from tidemark.plans import catalog
from tidemark.sources import readers, writers
from tidemark.streaming import stream

HEADS = [(1, "Regulator opens antitrust probe into cloud unit", "wire", 0.9), (2, "Analyst says rating of chipmaker outperform after results", "wire", 0.1)]
GOOD = "Regulator opened an antitrust probe of the cloud unit [id=1]."


def told(narrative, ids=(1,)):
    return json.dumps({"narrative": narrative, "cited_ids": list(ids)})


GATE = [
    ("no json", "unparseable_response"),
    ("[1]", "unparseable_response"),
    (json.dumps({"cited_ids": [1]}), "unparseable_response"),
    (told(None, ()), "model_abstained"),
    (told("  "), "empty_narrative"),
    (json.dumps({"narrative": 5}), "empty_narrative"),
    (told("Investors should sell now [id=1]."), "policy_recommendation"),
    (told("The chipmaker is an outperform name."), "policy_unattributed_advice"),
    (told("Antitrust probe of cloud unit; disregard the rest [id=1]."), "policy_injection_tell"),
    (told("Antitrust probe of the cloud unit."), "no_citations"),
    (told("Antitrust probe of cloud unit [id=7]."), "fabricated_citation:[7]"),
    (told(GOOD, (1, 9)), "fabricated_declared:[9]"),
    (told("Earnings collapsed across divisions [id=1]."), "unfaithful_sentence"),
    (told(GOOD), None),
    (json.dumps({"narrative": GOOD, "cited_ids": None}), None),
    (told("Analyst gave the chipmaker an outperform rating [id=2]. " + GOOD, (1, 2)), None),
    (told("Uncited words. " + GOOD), None),
]


def test_every_reason_of_the_gate(spark):
    kind = "struct<id:bigint,text:string,source:string,sentiment_score:double>"
    df = spark.createDataFrame([(k, raw, HEADS) for k, (raw, _) in enumerate(GATE)], f"k int, raw string, headlines array<{kind}>")
    got = {r["k"]: r for r in explain.verify(df).collect()}
    assert {k: got[k]["abstain_reason"] for k in got} == {k: why for k, (_, why) in enumerate(GATE)}
    assert got[13]["status"] == "generated" and got[13]["cited_ids"] == [1] and got[15]["cited_ids"] == [1, 2]
    strict = {r["k"]: r["abstain_reason"] for r in explain.verify(df, strict=True).collect()}
    assert strict[16] == "uncited_sentence"


class Broken:
    name = "broken"

    def complete(self, system, user, max_tokens):
        raise TimeoutError


def test_whole_conversations_are_judged(spark, tmp_path):
    filler = "Shares of the company moved after the quarterly report was published. " * 5
    rows = [(1, 1, "assistant", filler + "You should buy the stock now."), (2, 1, "assistant", filler + "See also [id=99]."), (4, 1, "user", "Why?")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r["conv_id"]: r["abstain_reason"] for r in catalog.c08(spark, str(tmp_path)).collect()}
    assert set(out) == {1, 2} and out[1].startswith("policy_") and out[2] == "fabricated_citation:[99]"


def test_explanations_abstain_on_failure(spark):
    kind = "struct<id:bigint,text:string,source:string,sentiment_score:double>"
    df = spark.createDataFrame(
        [(1, "A", "Firm", "2026-01-02", "note", "high", HEADS[:1]), (2, "B", "Firm", "2026-01-02", "note", "low", [])],
        f"alert_id int, ticker string, company_name string, date string, sigma_explanation string, severity string, headlines array<{kind}>",
    )
    out = {r["alert_id"]: r for r in explain.explain(df).collect()}
    assert out[1]["status"] == "generated" and out[1]["cited_ids"] == [1] and out[1]["model"] == "template"
    assert (out[2]["status"], out[2]["abstain_reason"], out[2]["model"]) == ("abstained", "no_headlines", None)
    broken = {r["alert_id"]: r["abstain_reason"] for r in explain.explain(df, Broken()).collect()}
    assert broken == {1: "llm_error:TimeoutError", 2: "no_headlines"}


def test_json_out_of_prose():
    assert X.first_json('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert X.first_json('Sure: {"a": {"b": "}"}} and more {') == '{"a": {"b": "}"}}'
    assert X.first_json("none") == "none"


def test_html_to_text():
    html = "<p>One&nbsp;two</p><script>no()</script><style>x</style><div>three<br>four &amp; five</div>"
    assert X.html_to_text(html).strip() == "One two three four & five"
    assert X.html_to_text(None) == ""


LONG = "We face risks and competition. " * 100


@pytest.mark.parametrize(
    "text,status",
    [
        (f"Item 1A. Risk Factors We begin {LONG} Item 1B. Unresolved Staff Comments None", "extracted"),
        (f"Item 1A Risk Factors 12 Item 1B x. Item 1A. Risk Factors Our {LONG} Item 2. Properties", "extracted"),
        ("Item 1A. Risk Factors This is incorporated by reference to an exhibit.", "incorporated_by_reference"),
        ("Item 1A. See the annual report to shareholders.", "incorporated_by_reference"),
        (f"see Risk Factors Section above {LONG[:100]}", "not_found"),
        ("Item 1A. Risk Factors Too short. Item 1B. Unresolved Staff Comments", "not_found"),
        ("", "not_found"),
    ],
)
def test_risk_sections(text, status):
    found = X.risk_section(text)
    assert found[0] == status and (found[1] is not None) == (status == "extracted")


def test_flags_of_sections():
    assert X.risk_section("Item 1A. Risk Factors We " + "x" * 300_001)[3] == ["suspiciously_long_possible_overrun"]
    assert X.risk_section(f"Item 1A. Risk Factors We {LONG} Cross Reference")[3] == ["possible_toc_overrun_at_end"]


def test_word_pieces_keep_the_closing_mark():
    v = {"[CLS]": 0, "[SEP]": 1, "[UNK]": 2, "risk": 3, "##y": 4, ".": 5}
    assert X.word_pieces("Risky risk. zzz", v)[0] == [0, 3, 4, 3, 5, 2, 1]
    ids, mask, types = X.word_pieces("risk " * 600, v)
    assert len(ids) == 512 and ids[-1] == 1 and len(mask) == len(types) == 512


def test_sentences_words_and_citations(spark):
    df = spark.createDataFrame([("A long enough sentence here. No. Is this one also long enough? Yes it is, surely so!",), (None,)], "t string")
    assert [r[0] for r in df.select(expr.sentences(F.col("t"))).collect()] == [["A long enough sentence here.", "Is this one also long enough?", "Yes it is, surely so!"], []]
    one = spark.createDataFrame([("The [id=1, id=2] company's Probe, probe [id=3]",)], "t string")
    row = one.select(expr.cited_ids(F.col("t")), expr.content_words(expr.without_citations(F.col("t"))), expr.citation_parts(F.col("t"))).first()
    assert row[0] == [1, 2, 3] and row[1] == ["probe"]
    assert [(p["kind"], p["part"]) for p in row[2]] == [("text", "The "), ("cite", "[id=1, id=2]"), ("text", " company's Probe, probe "), ("cite", "[id=3]")]


def test_scores_of_documents(spark):
    df = spark.createDataFrame([(1, "Losses and impairment hurt results badly. Strong growth and record profit followed."), (2, None), (3, "short")], "id int, t string")
    out = {r["id"]: r for r in X.score_documents(df, "id", "t").collect()}
    assert out[1]["n_sentences"] == 2 and out[1]["max_negative"] > out[1]["mean_negative"] and out[1]["capped"] is False
    assert out[2]["n_sentences"] == 0 and out[2]["mean_negative"] is None and out[3]["n_sentences"] == 0


def test_unusual_text_rounds_as_python_does():
    assert X.unusual("A", "2026-01-02", [2.25, -3.0, 0.5, 1.0], -0.61234) == "Unusual for A on 2026-01-02: negative -3.0σ, news volume +2.2σ, |return| +1.0σ. Anomaly score -0.612."
    assert "|return| +0.4σ" in X.unusual("A", "d", [0.1, 0.2, 0.3, 0.4], 0.0)


def test_forest_flags_extremes(spark):
    rng = np.random.default_rng(1)
    rows = [(f"T{k % 10}", dt.date(2026, 1, 1) + dt.timedelta(days=k // 10), float(rng.poisson(5)), float(rng.random()), float(rng.random()), float(abs(rng.normal()))) for k in range(600)]
    rows[77] = (*rows[77][:2], 90.0, 9.0, 9.0, 30.0)
    df = spark.createDataFrame(rows, "ticker string, day date, news_n double, news_neg double, neg_ratio double, abs_ret double")
    one = [tuple(r) for r in anomaly.run_detection(df, trees=60).select("ticker", "day", "score").collect()]
    two = [tuple(r) for r in anomaly.run_detection(df.repartition(7), trees=60).select("ticker", "day", "score").collect()]
    assert [x[:2] for x in one] == [x[:2] for x in two] and one[0][:2] == rows[77][:2]
    assert 10 <= len(one) <= 20
    assert anomaly.run_detection(df.limit(0)).count() == 0


def test_upserts(spark):
    old = spark.createDataFrame([("u1", "h1", "b1")], "url string, headline string, body string")
    new = spark.createDataFrame([("u1", "h2", "b2", 2), ("u1", "h3", "b3", 3), ("u2", "x1", "y1", 1), ("u2", "x2", "y2", 4)], "url string, headline string, body string, seq int")
    assert sorted(map(tuple, writers.upsert_articles(old, new).collect())) == [("u1", "h3", "b1"), ("u2", "x2", "y1")]
    known = spark.createDataFrame([("1", "A", "Name", "Tech", "9")], "cik string, ticker string, name string, sector string, sic_code string")
    change = spark.createDataFrame([("1", "B", "New", None, None, 1)], "cik string, ticker string, name string, sector string, sic_code string, seq int")
    assert [tuple(r) for r in writers.upsert_companies(known, change).collect()] == [("1", "A", "New", "Tech", "9")]
    alerts = spark.createDataFrame([(1, "generated", [3])], "alert_id int, status string, cited_ids array<int>")
    again = spark.createDataFrame([(1, "abstained", [], 1)], "alert_id int, status string, cited_ids array<int>, seq int")
    assert [tuple(r) for r in writers.upsert_explanations(alerts, again).collect()] == [(1, "abstained", None)]


def test_partitions_are_replaced_and_counted(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.replace_partition(spark.createDataFrame([(1, "a"), (2, "b")], "id int, kind string"), path, "kind")
    assert writers.replace_partition(spark.createDataFrame([(3, "a"), (4, "a")], "id int, kind string"), path, "kind") == 2
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [2, 3, 4]
    assert writers.rebuild(spark.range(5), str(tmp_path / "r")) == 5
    writers.export_csv(spark.createDataFrame([("B", 0.1234567), ("A", 2.0)], "t string, x double"), str(tmp_path / "c"), ["t"], {"x": 6})
    text = "".join(sorted(p.read_text() for p in (tmp_path / "c").glob("*.csv")))
    assert text.index("A,2.0") < text.index("B,0.123457")


def test_keys_literals_and_dumps(spark):
    now = dt.datetime(2026, 1, 1, 12)
    raw, row = writers.demo_key(30, dt.timedelta(hours=24), now)
    keys = spark.createDataFrame([(row["key_hash"], True, row["expires_at"], None), ("x", True, now, None), ("y", False, None, None)], "key_hash string, active boolean, expires_at timestamp, last_used_at timestamp")
    assert [r["key_hash"] for r in keys.where(writers.valid_key(F.lit(now))).collect()] == [row["key_hash"]]
    used = {r["key_hash"]: r["last_used_at"] for r in writers.touch(keys, row["key_hash"], now).collect()}
    assert used[row["key_hash"]] == now and used["x"] is None
    assert keys.select(expr.hashed(F.lit(raw))).first()[0] == row["key_hash"]
    assert [writers.sql_literal(v) for v in (None, True, 3, "o'k", [1, 2])] == ["NULL", "TRUE", "3", "'o''k'", "'{1,2}'"]
    lines = list(writers.sql_dump([("t", spark.createDataFrame([(1, "a")], "id int, s string"))]))
    assert lines[0] == "INSERT INTO t (id, s) VALUES (1, 'a') ON CONFLICT DO NOTHING;" and "setval" in lines[1]


def test_scans_of_nested_sources(spark):
    raw = spark.createDataFrame([('{"0": {"cik_str": "320193", "ticker": "aapl", "title": "x"}}',)], "value string")
    assert [tuple(r) for r in readers.ticker_to_cik(raw).collect()] == [("AAPL", "0000320193")]
    subs = spark.createDataFrame([("1", ["10-K", "8-K", " 10-K "], ["a", "b", "c"], ["2026-01-01", "2026-01-02", "2025-01-01"], ["d", "e", "f"])], "cik string, form array<string>, accessionNumber array<string>, filingDate array<string>, primaryDocument array<string>")
    found = readers.filings_of(subs)
    assert sorted(r["accession_number"] for r in found.collect()) == ["a", "c"]
    assert ingest.latest_filings(found, n=1).first()["accession_number"] == "a"
    url = found.select(readers.filing_url(F.lit("0000320193"), F.lit("0001-24-1"), F.lit("d.htm"), "b")).first()[0]
    assert url == "b/320193/0001241/d.htm"
    feed = spark.createDataFrame([("u", "h", None, None, "1700000000", "A", 2), ("u", "h2", " b ", "s", "0", "A", 1), ("", "x", None, None, None, "A", 3)], "url string, headline string, summary string, source string, datetime string, ticker string, seq int")
    rows = ingest.normalise_articles(feed).orderBy("seq").collect()
    assert [(r["headline"], r["source"], r["body"], r["published_at"]) for r in rows] == [("h2", "s", "b", None), ("h", "unknown", None, dt.datetime(2023, 11, 14, 22, 13, 20))]
    companies = spark.createDataFrame([(7, "A")], "id int, ticker string")
    articles, links = ingest.store_news(feed, companies)
    assert articles.first()["headline"] == "h" and [tuple(r) for r in links.collect()] == [("u", 7)]


def test_ingest_statuses(spark):
    tickers = spark.createDataFrame([("a",), ("b",), ("c",)], "ticker string")
    ciks = spark.createDataFrame([("A", "1"), ("B", "2")], "ticker string, cik string")
    filings = spark.createDataFrame([("1", "x", dt.date(2026, 1, 1), f"<p>Item 1A. Risk Factors We {LONG}</p>")], "cik string, accession_number string, filed_date date, html string")
    out = ingest.ingest(tickers, ciks, filings)
    assert {r["ticker"]: r["status"] for r in out.collect()} == {"A": "extracted", "B": "no_filings", "C": "not_found"}
    report = ingest.quality_report(out).first()
    assert (report["total"], report["extracted"], report["usable_rate"]) == (3, 1, pytest.approx(1 / 3))


def test_model_gates(spark):
    pairs = spark.createDataFrame([([1.0, 2.0, 0.0], [1.0, 2.1, 0.0]), ([3.0, 1.0, 0.0], [3.0, 1.0, 0.5])], "a array<float>, b array<float>")
    good = modelops.quantization_verdict(modelops.agreement(pairs, "a", "b")).first()
    assert good["flips"] == 0 and good["accepted"] and good["tolerance"] >= 0.05 and good["max_diff"] == 0.5
    flip = spark.createDataFrame([([1.0, 2.0, 0.0], [2.5, 2.1, 0.0])], pairs.schema)
    bad = modelops.quantization_verdict(modelops.agreement(flip, "a", "b")).first()
    assert (bad["flips"], bad["accepted"], bad["agreement"]) == (1, False, 0)
    kind = "text string, input_ids array<long>, logits array<float>, ids array<long>, own array<float>"
    verdict = lambda rows: modelops.parity_verdict(modelops.parity(spark.createDataFrame(rows, kind), "ids", "own")).first()
    assert verdict([("t" * 99, [1, 2], [0.5, 0.1], [1, 2], [0.5, 0.1])])["passed"]
    assert "tokenizers" in verdict([("t", [1, 2], [0.5], [1, 3], [0.5])])["diagnosis"]
    assert "runtimes" in verdict([("t", [1], [0.5], [1], [0.6])])["diagnosis"]
    runs = spark.createDataFrame([("r1", 1, True), ("r2", 2, False)], "run_id string, start_time int, parity_passed boolean")
    assert tuple(modelops.promotion(runs).first()) == ("r2", True, False, 1)
    assert tuple(modelops.promotion(runs, "r1").first()) == ("r1", True, True, 0)
    assert modelops.promotion(runs, "none").count() == 0


def test_feed_parameters(spark):
    assert [expr.limit_of(x) for x in (None, 0, -4, 500, 7)] == [50, 50, 1, 200, 7]
    assert expr.optional("  ") is None and expr.optional(" aa ", upper=True) == "AA"
    alerts = spark.createDataFrame([(1, 1, dt.datetime(2026, 1, 1), "t", "low", "e", False), (2, 1, dt.datetime(2026, 1, 2), "t", "high", "e", False), (3, 1, dt.datetime(2026, 1, 3), "t", None, "e", False)], "id int, company_id int, triggered_at timestamp, alert_type string, severity string, explanation string, resolved boolean")
    companies = spark.createDataFrame([(1, "A", "Firm")], "id int, ticker string, name string")
    assert [r["alert_id"] for r in evidence.alert_feed(alerts, companies).collect()] == [2, 1, 3]
    assert tuple(anomaly.severity_counts(alerts).first()) == (3, 1, 0, 2)


def test_streamed_limiter_is_that_of_the_batch(spark, tmp_path):
    rng = random.Random(4)
    start = dt.datetime(2026, 1, 1)
    rows = sorted((start + dt.timedelta(seconds=rng.randint(0, 900)), rng.choice("ab"), k) for k in range(80))
    schema = "ts timestamp, key string, id int"
    for part in range(2):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
        for f in (tmp_path / "in" / str(part)).glob("*.parquet"):
            f.rename(tmp_path / f"{part}.parquet")
    import shutil

    shutil.rmtree(tmp_path / "in")
    source = stream.file_stream(spark, str(tmp_path / "*.parquet"), schema, 1)
    out = stream.limited(source, 3, 120.0)
    q = out.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["id"], r["allowed"], r["retry_after"]) for r in spark.table("limited").collect())
    df = spark.createDataFrame(rows, schema)
    assert got == sorted((r["id"], r["allowed"], r["retry_after"]) for r in limits.admit(df, 3, 120.0).collect())


def test_streamed_upserts_and_days(spark, tmp_path):
    schema = "url string, headline string, body string, published_at timestamp, seq int, ticker string, neg double, label string"
    rows = [(f"u{k % 5}", f"h{k}", f"b{k}", dt.datetime(2026, 1, 1 + k // 10), k, "A", 0.5, "negative") for k in range(40)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = stream.file_stream(spark, str(tmp_path / "in"), schema)
    table = str(tmp_path / "table")
    write = stream.upserting(table, ["url"], ["headline"], "seq", buckets=4)
    columns = ["url", "headline", "body"]
    kinds = source.select(*columns).schema
    assert stream.current(spark, table, kinds).count() == 0
    state = lambda: sorted(map(tuple, stream.current(spark, table, kinds).select(*columns).collect()))
    stream.drain(source.select(*columns, "seq"), write, str(tmp_path / "cp1")).awaitTermination()
    assert state() == [(f"u{k}", f"h{35 + k}", f"b{k}") for k in range(5)]
    old = {p.relative_to(table) for p in (tmp_path / "table").rglob("*.parquet")}
    more = spark.createDataFrame([("u1", "new", "x", 50), ("u9", "first", "y", 51), ("u9", "last", "z", 52)], "url string, headline string, body string, seq int")
    for _ in range(2):  # a batch that is run again changes nothing
        write(more, 1)
        assert state() == [("u0", "h35", "b0"), ("u1", "new", "b1"), *((f"u{k}", f"h{35 + k}", f"b{k}") for k in (2, 3, 4)), ("u9", "last", "y")]
    now = {p.relative_to(table) for p in (tmp_path / "table").rglob("*.parquet")}
    assert old < now and 1 <= len({p.parts[0] for p in now - old}) <= 2  # only the buckets of u1 and u9
    q = stream.daily(source).writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["date"].day, r["news_n"]) for r in spark.table("days").collect()} >= {(1, 10)}


def test_scored_articles(spark):
    df = spark.createDataFrame([(1, "Record profit", None, False), (2, "Loss", "Fraud and default", None), (3, "Old", None, True)], "id int, headline string, body string, processed boolean")
    out = {r["id"]: r for r in stream.score_articles(df).collect()}
    assert set(out) == {1, 2} and out[1]["sentiment_label"] == "positive" and out[2]["sentiment_label"] == "negative" and out[1]["processed"]


def test_filters_reach_the_scan(spark, capsys):
    df = catalog.QUERIES["j04_asof_cutoff"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_custkey" in plan and "c_name" not in plan


def test_queries_run_on_the_smallest_tables(spark):
    for name in ("w04_zscore_severity", "c20_alert_feed", "c16_backtest_momentum", "a06_bucket_means"):
        out = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(out.collect()) > 0 and all(out.columns)
