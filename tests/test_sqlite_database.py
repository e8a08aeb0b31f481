"""A database in a file that tasks of any process reach: copies that start again, and scans in ranges."""

from types import SimpleNamespace

import pytest

from tidemark.plans import catalog_more
from tidemark.sources import jdbc


def test_copy_and_scan(spark, tmp_path):
    url = f"sqlite:{tmp_path}/tables.db"
    rows = spark.createDataFrame([(k, f"00{k}'s" if k % 7 else None, k / 4, k % 3) for k in range(-20, 100)], "id long, name string, x double, n int")
    assert not jdbc.exists(spark, url, "t")
    jdbc.copy({"t": rows.where("id % 3 = 0")}, {"t": "id"}, {}, url)
    for _ in range(2):
        assert jdbc.copy({"t": rows}, {"t": "id"}, {}, url) == {"t": 120}
    found = jdbc.scan(spark, url, "t", "id", 5)
    assert found.dtypes == rows.dtypes and found.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))
    empty = jdbc.copy({"none": rows.limit(0)}, {"none": "id"}, {}, url)
    assert empty == {"none": 0} and jdbc.exists(spark, url, "none")


def test_executors_of_their_own_get_a_file(spark, monkeypatch, tmp_path):
    apart = SimpleNamespace(sparkContext=SimpleNamespace(master="local-cluster[3,2,3072]"))
    monkeypatch.setattr(catalog_more, "scratch_path", lambda _: f"file://{tmp_path}/new")
    assert catalog_more.database(apart) == f"sqlite:{tmp_path}/new/tables.db"
    monkeypatch.setattr(catalog_more, "scratch_path", lambda _: "hdfs://name/new")
    with pytest.raises(ValueError):
        catalog_more.database(apart)
    assert catalog_more.database(spark).startswith("jdbc:derby:memory:")
