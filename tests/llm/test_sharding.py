from collections import Counter

import pytest

from loomframe.llm import sharding


def test_turns_balance_and_stability():
    names = [f"n{k}" for k in range(16)]
    full = sharding.lookup_table(names, 2039)
    counts = Counter(full)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    less = sharding.lookup_table(names[:-1], 2039)
    moved = sum(a != b for a, b in zip(full, less) if a != 15)
    assert moved < 2039 * 0.25
    assert sharding.lookup_table(["a"], 2) == [0, 0]
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 7)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 8)


def test_place(spark):
    rows = [(k, "x") for k in range(3000)] + [(5, "again"), (None, "null")]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    out = sharding.place(df, "doc_id").collect()
    table = sharding.lookup_table([f"shard-{k:05d}" for k in range(sharding.SHARDS)], sharding.SLOTS)
    assert len(out) == len(rows)
    for r in out:
        assert r.slot == sharding.digest("" if r.doc_id is None else str(r.doc_id)) % sharding.SLOTS and r.shard == table[r.slot]
    assert sum(r.n_rows for r in sharding.sizes(sharding.place(df, "doc_id")).collect()) == len(rows)
    assert sharding.place(df.limit(0), "doc_id").collect() == []
    with pytest.raises(ValueError):
        sharding.place(df.withColumnRenamed("source", "Shard"), "doc_id")
