"""Parts that several operators use."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import _shared


@pytest.mark.parametrize("hub", [100_000, 1])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(_shared, "HUB", hub)
    r = random.Random(3)
    links = [(1, i) for i in range(2, 60)] + [(i, i + 1) for i in range(100, 140)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(70)] + [(7, 7), (None, 3), (60, 100)]
    part = {n: n for x in links for n in x if None not in x}

    def root(n):
        while part[n] != n:
            n = part[n]
        return n

    for a, b in (x for x in links if None not in x):
        low, high = sorted((root(a), root(b)))
        part[high] = low
    alone = {n for n in part if not any(n in x and x[0] != x[1] and None not in x for x in links)}
    got = _shared.connected_components(spark.createDataFrame(links, "a long, b long").repartition(3), nodes=300).collect()
    assert {x.node: x.component for x in got} == {n: root(n) for n in part if n not in alone} and len(got) == len({x.node for x in got})
    assert _shared.connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_complete_groups():
    r = np.random.default_rng(1)
    for _ in range(200):
        k = np.sort(r.integers(0, r.integers(1, 60), r.integers(0, 400)))
        limit, least, size = (int(r.integers(1, n)) for n in (40, 60, 70))
        batches = [pa.record_batch({"k": k[i : i + size], "i": np.arange(i, min(i + size, len(k)))}) for i in range(0, len(k), size)]
        out = list(_shared.complete_groups(iter(batches), "k", limit, least))
        assert [i for t, _ in out for i in t["i"].to_pylist()] == list(range(len(k)))
        for key in set(k.tolist()):
            found = [over for t, over in out if key in t["k"].to_pylist()]
            assert found == [False] or all(found) and np.count_nonzero(k == key) > limit
        assert all(over or t.num_rows < least + np.bincount(k).max() for t, over in out)


def test_scans_are_dealt_out_to_all_cores(spark, tmp_path):
    spark.range(1000).selectExpr("id as doc_id", "cast(id as string) as text").coalesce(1).write.parquet(str(tmp_path / "one"))
    docs = spark.read.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    assert docs.rdd.getNumPartitions() == 1 and _shared.keyed(docs).rdd.getNumPartitions() == cores
    assert _shared.keyed(docs).count() == 1000 and _shared.dealt_out(docs.repartition(2)).rdd.getNumPartitions() == 2


def test_written_tables_and_their_end(spark):
    df = _shared.written(spark.range(10).repartition(4), rows=10)
    assert df.count() == 10 and len(df.inputFiles()) == 1
    _shared.remove(spark, df.written_to)
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(df.written_to).count()


def test_rows_without_ids_are_apart(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    rows = _shared.apart(_shared.keyed(docs)).collect()
    assert len({(r._id, r._h) for r in rows}) == 4 and sorted(r._t for r in rows) == ["", "a", "a", "a", "a"]


def test_remembered():
    asked = []
    memory = _shared.Remembered(lambda names: [asked.append(x) or x.upper() for x in names], 2)
    assert memory(["a", "b", "c"]) == ["A", "B", "C"] and memory(["a", "d"]) == ["A", "D"] and memory(["e", "f", "a"]) == ["E", "F", "A"]
    assert memory(["a", "b"]) == ["A", "B"] and asked == ["a", "b", "c", "d", "e", "f", "b"]
