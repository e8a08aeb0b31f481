"""Small buckets of a merged table share files, and each is still replaced by itself."""

from tidemark.streaming import keyed

KINDS = "url string, headline string, body string"


def test_small_buckets_share_files(spark, tmp_path):
    rows = [(f"u{k}", "first", f"b{k}", k) for k in range(395)]
    batch = lambda rows: spark.createDataFrame(rows, f"{KINDS}, seq long")
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), batch([]).drop("seq").schema, ["url"], rows=10)
    files = lambda: len(list((tmp_path / "t" / "data").rglob("part-*.parquet")))
    before = table.merge(batch(rows), 0, ["headline"], "seq")
    assert len(before.held) == 40 and files() == 1
    after = table.merge(batch([("u5", "new", "x", 999)]), 1, ["headline"], "seq")
    assert sum(x != y for x, y in zip(before.held, after.held)) == 1 and files() == 2
    # the older rows of that bucket are in a folder that still holds the others
    want = {(u, "new" if u == "u5" else h, b) for u, h, b, _ in rows}
    got = [tuple(r) for r in table.read().collect()]
    assert len(got) == 395 and set(got) == want
    assert {tuple(r) for r in table.read(0).collect()} == {r[:3] for r in rows}
    assert table.expire() == [] and set(map(tuple, table.read().collect())) == want
    table.compact()
    assert len(table.expire()) == 2 and set(map(tuple, table.read().collect())) == want
