"""Streams: the limiter with state, merged tables, drains, days of a calendar, pages."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import limits
from tidemark.streaming import keyed, stream

T0 = dt.datetime(2026, 1, 1)


def feed(spark, rows, schema, path, parts):
    """``rows`` as a stream of ``parts`` files in their order."""
    size = -(-len(rows) // parts)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").parquet(str(path))
    return stream.file_stream(spark, str(path), schema, 1)


def run(spark, out, name, path):
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path))
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


REQUESTS = "ts timestamp, key long, id long"


def request_rows(n=150):
    rng = random.Random(1)
    keys = [None, 2**53, 2**53 + 1, 7]
    rows = [(T0 + dt.timedelta(microseconds=rng.randint(0, 900_000_000)), rng.choice(keys), k) for k in range(n)]
    rows += [(T0 + dt.timedelta(seconds=600), 7, 1000 + k) for k in range(6)]  # one moment
    return sorted(rows, key=lambda r: r[0].timestamp() + rng.random() * 100)


def brute_admit(rows, limit, window):
    hits, out = {}, {}
    for t, k, i in sorted(rows, key=lambda r: (r[0], r[2])):
        live = hits[k] = [x for x in hits.get(k, []) if x > t - dt.timedelta(seconds=window)]
        if limit and len(live) >= limit:
            left = (live[0] + dt.timedelta(seconds=window) - t) / dt.timedelta(microseconds=1)
            out[i] = (k, False, max(1, -int(-left // 1_000_000)))
        else:
            live.append(t)
            out[i] = (k, True, None)
    return out


def test_batch_limiter_keeps_keys(spark):
    rows = request_rows()
    df = spark.createDataFrame(rows, REQUESTS).repartition(3)
    got = {r["id"]: (r["key"], r["allowed"], r["retry_after"]) for r in limits.admit(df, 2, 60.0).collect()}
    assert got == brute_admit(rows, 2, 60)
    nulls = spark.createDataFrame([(T0 + dt.timedelta(seconds=k), None, k) for k in range(5)], REQUESTS)
    assert [r["allowed"] for r in limits.admit(nulls, 1).orderBy("id").collect()] == [True] + [False] * 4
    untimed = spark.createDataFrame([(None, 1, 1), (T0, 1, 2)], REQUESTS)
    assert {r["id"]: r["allowed"] for r in limits.admit(untimed, 1).collect()} == {1: None, 2: True}
    assert limits.admit(spark.createDataFrame([], REQUESTS), 1).collect() == []


@pytest.mark.parametrize("limit", [3, 0])
def test_limiter_waits_for_its_turn(spark, tmp_path, limit):
    """Requests come out of order over six triggers, and some too late; the rest is as in one batch."""
    rows = request_rows()
    late = [(T0 + dt.timedelta(seconds=5), 7, -2), (T0 - dt.timedelta(days=1), None, -3)]
    end = [(dt.datetime(2030, 1, 1), None, -1)]
    source = feed(spark, [*rows, *end, *late], REQUESTS, tmp_path / "in", 6)
    out = run(spark, stream.limited(source, limit, 120.0, late="300 seconds", slot=60.0), f"turn{limit}", tmp_path / "at")
    got = {r["id"]: (r["key"], r["allowed"], r["retry_after"]) for r in out.collect()}
    want = brute_admit(rows, limit, 120)
    closed = {k: v for k, v in got.items() if k >= 0}
    assert {k: v for k, v in want.items() if k in closed} == closed and len(closed) == len(want)
    assert {r["id"]: r["ts"] for r in out.collect() if r["id"] >= 0} == {i: t for t, _, i in rows}
    with pytest.raises(ValueError):
        stream.limited(source, 1, slot=0.0005)


def test_limiter_forgets(spark, tmp_path):
    """The state of quiet keys goes, and a key that comes back starts anew."""
    rows = [(T0, 1, 0), (T0 + dt.timedelta(seconds=1), 1, 1), (T0 + dt.timedelta(hours=9), 2, 2), (T0 + dt.timedelta(hours=19), 1, 3), (T0 + dt.timedelta(hours=30), 3, 4)]
    source = feed(spark, rows, REQUESTS, tmp_path / "in", 5)
    out = run(spark, stream.limited(source, 1, 60.0, late="1 minute"), "forgets", tmp_path / "at")
    assert {r["id"]: r["allowed"] for r in out.collect()} == {0: True, 1: False, 2: True, 3: True, 4: True}


def test_clients(spark):
    df = spark.createDataFrame([(" 1.2.3.4 , 5.6.7.8", "9.9.9.9"), (None, "9.9.9.9"), ("", "9.9.9.9"), (None, None)], "f string, r string")
    got = [r[0] for r in df.select(limits.client(F.col("f"), F.col("r"))).collect()]
    assert got == ["mint:1.2.3.4", "mint:9.9.9.9", "mint:9.9.9.9", "mint:unknown"]


# --- merged tables

KINDS = "url string, headline string, body string"


def changes(spark, rows):
    return spark.createDataFrame(rows, f"{KINDS}, seq long")


def merged(rows):
    """First values of each url, and its last headline."""
    out = {}
    for u, h, b, _ in sorted(rows, key=lambda r: r[3]):
        out[u] = (u, h, out[u][2] if u in out else b)
    return sorted(out.values(), key=str)


def table_at(spark, path, rows=20):
    return keyed.KeyedTable(spark, str(path), changes(spark, []).drop("seq").schema, ["url"], rows)


def shown(df):
    return sorted(map(tuple, df.collect()), key=str)


def batches(seed=3):
    rng = random.Random(seed)
    out, seq = [], 0
    for _ in range(5):
        rows = []
        for _ in range(40):
            seq += 1
            rows.append((rng.choice([None, *(f"u{k}" for k in range(120))]), f"h{seq}", f"b{seq}", seq))
        out.append(rows)
    return out


def test_addresses(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("url"))
    was = None
    for n in range(1, 20):
        now = {r["url"]: r["b"] for r in df.select("url", keyed.address(["url"], n).alias("b")).collect()}
        assert set(now.values()) <= set(range(n))
        if was:  # one more bucket takes rows from the one it was split from alone
            assert all(now[u] in (b, n - 1) for u, b in was.items())
            assert {was[u] for u in now if now[u] == n - 1} <= {keyed.parent(n - 1)}
        was = now


def test_merged_batches_and_splits(spark, tmp_path):
    table, known = table_at(spark, tmp_path / "t"), []
    assert table.read().count() == 0
    sizes = []
    for number, rows in enumerate(batches()):
        known += rows
        before = table.commit()
        after = table.merge(changes(spark, rows), number, ["headline"], "seq")
        assert shown(table.read()) == merged(known)
        assert after.rows == len(merged(known)) and len(after.held) >= len(before.held)
        assert table.merge(changes(spark, rows), number, ["headline"], "seq") == after  # again: nothing
        assert table.merge(changes(spark, rows[:3]), number - 1, ["headline"], "seq") == after
        sizes.append(len(after.held))
    assert sizes[-1] > sizes[0] > 1
    # a batch that names one key writes its bucket alone
    before, after = table.commit(), table.merge(changes(spark, [("u5", "new", "x", 999)]), 9, ["headline"], "seq")
    if len(before.held) == len(after.held):
        assert sum(x != y for x, y in zip(before.held, after.held)) == 1
    assert ("u5", "new") in {(r["url"], r["headline"]) for r in table.read().collect()}


def test_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    first, second, *_ = batches()
    table = table_at(spark, tmp_path / "t")
    table.merge(changes(spark, first), 0, ["headline"], "seq")
    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedTable, "_put", lambda self, commit: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.merge(changes(spark, second), 1, ["headline"], "seq")
    assert shown(table.read()) == merged(first)
    table.merge(changes(spark, second), 1, ["headline"], "seq")
    assert shown(table.read()) == merged(first + second)


def test_compaction_and_old_versions(spark, tmp_path):
    table, known = table_at(spark, tmp_path / "t", rows=10), []
    for number, rows in enumerate(batches()[:3]):
        known += rows
        table.merge(changes(spark, rows), number, ["headline"], "seq")
    middle = shown(table.read(1))
    assert middle == merged([r for rows in batches()[:2] for r in rows])
    wide = table_at(spark, tmp_path / "t", rows=1000)
    assert len(wide.compact().held) == 1 and shown(table.read()) == merged(known)
    assert shown(table.read(1)) == middle
    gone = wide.expire(keep=1)
    assert gone and len(wide.versions()) == 1 and shown(table.read()) == merged(known)
    assert len(list((tmp_path / "t" / "data").rglob("bucket=*"))) == 1
    # batches go on where they were
    more = [("u1", "late", "z", 9999)]
    assert wide.merge(changes(spark, more), 2, ["headline"], "seq") == wide.commit()
    wide.merge(changes(spark, more), 3, ["headline"], "seq")
    assert shown(wide.read()) == merged(known + more)


def test_two_sources(spark, tmp_path):
    table = table_at(spark, tmp_path / "t")
    table.merge(changes(spark, [("a", "1", "x", 1)]), 5, ["headline"], "seq", source="one")
    table.merge(changes(spark, [("a", "2", "y", 2)]), 0, ["headline"], "seq", source="two")
    assert shown(table.read()) == [("a", "2", "x")]
    other = table_at(spark, tmp_path / "t")
    stale = other.commit()
    stale.version -= 1
    with pytest.raises(RuntimeError):
        other._put(keyed.Commit(1, {}, []))


# --- drains, days, pages


def test_drain_stops_and_goes_on(spark, tmp_path):
    kinds = "id long, headline string, body string, processed boolean"
    rows = [(k, "Record profit" if k % 2 else "Loss and fraud", None, k % 5 == 0) for k in range(40)]
    source = feed(spark, rows[:20], kinds, tmp_path / "in", 4)
    write, calls = stream.numbered(str(tmp_path / "out")), []

    def failing(batch, number):
        write(batch, number)
        calls.append(number)
        if len(calls) == 2:
            raise RuntimeError("stopped after the write")

    scored = stream.score_articles(source).select("id", "sentiment_label", "processed")
    with pytest.raises(Exception, match="stopped"):
        stream.drain(scored, failing, str(tmp_path / "at")).awaitTermination()
    feed(spark, rows[20:], kinds, tmp_path / "in", 2)
    stream.drain(scored, failing, str(tmp_path / "at")).awaitTermination()
    got = sorted((r["id"], r["sentiment_label"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(k, "positive" if k % 2 else "negative") for k, _, _, p in rows if not p]
    assert len(calls) == len(set(calls)) + 1  # one batch was written twice


def test_days_over_changes_of_time(spark, tmp_path):
    """23 hours on 8 March, 25 on 1 November 2026; the days are those of ``panel.calendar_features``."""
    from tidemark.operators import panel

    kinds = "ticker string, published_at timestamp, neg double, label string"
    rows = []
    for day in (dt.datetime(2026, 3, 7), dt.datetime(2026, 10, 31)):
        rows += [("A", day + dt.timedelta(minutes=30 * k), k % 7 / 7, "negative" if k % 3 else "x") for k in range(144)]
    rows += [("B", None, 0.5, "x"), ("A", dt.datetime(2026, 12, 25), 0.0, "x")]
    rows.append(("A", dt.datetime(2026, 3, 8), 9.0, "x"))  # too late by far
    source = feed(spark, rows, kinds, tmp_path / "in", 6)
    out = run(spark, stream.daily(source, zone="America/New_York"), "newyork", tmp_path / "at")
    got = {(r["ticker"], r["date"]): (r["news_n"], r["news_neg"], r["neg_ratio"]) for r in out.collect()}
    batch = panel.calendar_features(spark.createDataFrame(rows[:-2], kinds).where("published_at is not null"))
    want = {(r["ticker"], r["date"]): (r["news_n"], r["news_neg"], r["neg_ratio"]) for r in batch.collect()}
    assert got == want
    assert got["A", dt.date(2026, 3, 8)][0] == 46 and got["A", dt.date(2026, 11, 1)][0] == 50


def test_pages(spark):
    ids = random.Random(5).sample(range(10**6), 1000)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(7)
    got = {r["id"]: r["page"] for r in stream.pages(df, "id", 64).collect()}
    assert got == {i: k // 64 for k, i in enumerate(sorted(ids))}
    after, seen = None, []
    while page := [r["id"] for r in stream.next_page(df, "id", after, 300).collect()]:
        seen += page
        after = page[-1]
    assert seen == sorted(ids)
    assert stream.pages(spark.createDataFrame([], "id long"), "id").collect() == []
