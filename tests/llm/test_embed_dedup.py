import math

import duckdb
import numpy as np

from loomframe.llm import embed_dedup
from loomframe.llm.sql import OP6_SQL

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def brute(rows):
    ok = {}
    for k, (_, v, label, _) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))
    links = {k: [j for j in ok if j != k and rows[j][2] == rows[k][2] and len(ok[j]) == len(ok[k]) and ok[j] @ ok[k] >= 0.98] for k in ok}
    up = {k: k for k in range(len(rows))}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, js in links.items():
        for j in js:
            a, b = sorted((find(j), find(k)), key=lambda i: rows[i][0])
            up[b] = a
    return [(rows[k][0], len(links.get(k, [])), rows[find(k)][0]) for k in range(len(rows))]


def data(n=150):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(n):
        base = rng.standard_normal(24)
        for _ in range(rng.integers(1, 5)):
            v = base + rng.standard_normal(24) * rng.choice([0, 0.02, 0.1, 0.2])
            rows.append((len(rows), v.astype(np.float32).tolist(), int(k % 3), "x"))
    rows += [(2000, rows[0][1], 0, "copy"), (2001, rows[0][1], 1, "other label"), (2002, None, 0, None), (2003, [0.0] * 24, 0, None), (2004, [1.0, None] + [0.0] * 22, 0, None), (2005, [float("nan")] * 24, 0, None), (2006, rows[0][1], None, None), (2007, [], 0, None), (2008, [1.0, 0.0], 0, None), (2009, [2.0, -0.0], 0, None), (2010, [float("inf")] * 24, 0, None)]
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = data()
    for chunk, block, large, cells in ((1 << 13, 1 << 13, 48, 1 << 21), (3, 5, 2, 9), (512, 40, 4, 30)):
        monkeypatch.setattr(embed_dedup, "CHUNK", chunk)
        monkeypatch.setattr(embed_dedup, "CELLS", cells)
        monkeypatch.setattr(embed_dedup, "BLOCK", block)
        monkeypatch.setattr(embed_dedup, "LARGE", large)
        got = embed_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(rows))
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_repeated_null_and_empty(spark):
    v = [1.0, 2.0, 3.0]
    got = embed_dedup.near_duplicates(spark.createDataFrame([(1, v, 0, ""), (1, v, 0, ""), (None, v, 0, ""), (2, v, 0, "")], SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.component_id) for r in got) == [(0, None), (1, 1), (1, 1), (2, 1)]
    assert {r.n_links for r in got} == {3}
    assert embed_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shared_and_null_ids_as_in_sql(spark):
    """Unlike vectors of one vec_id are one vertex; a null vec_id is counted but connects nothing."""
    con = duckdb.connect()
    near = lambda a: [math.cos(a), math.sin(a), 0.0]
    rows = [(3, near(0), 0), (5, near(0), 0), (5, [0.0, 0.0, 1.0], 0), (9, [0.0, 0.01, 1.0], 0), (5, None, 0), (7, [0.0] * 3, 0), (7, near(2), 1), (8, near(2.1), 1), (None, near(2.2), 1), (11, near(2.39), 1), (None, near(0), 0)]
    con.execute("create table embeddings (vec_id bigint, embedding float[], label int)")
    con.executemany("insert into embeddings values (?, ?, ?)", rows)
    want = con.sql(OP6_SQL).fetchall()
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r.component_id for r in got if r.vec_id in (3, 5, 9)} == {3}


def test_a_near_group_by_strips():
    """One bucket of near vectors: every pair is counted, the links are a spanning forest, by any strips."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    v = np.ones((700, 8)) + rng.standard_normal((700, 8)) * 0.08
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    n = len(v)
    block = pa.table({"node": np.arange(n) + 5, "weight": np.full(n, 2), "side": np.zeros(n, int), "named": np.arange(n) % 7 > 0, "t": np.zeros(n, int), "lo": np.zeros(n, int), "hi": np.zeros(n, int), "dim": np.full(n, 8), "codes": pa.array([[1]] * n), "v": pa.array(v.tolist())}).combine_chunks()
    found = embed_dedup.compared(block, np.array([0]), 0.98).to_pydict()
    counts = {a: b for k, a, b in zip(*found.values()) if k == 0}
    assert counts == {k + 5: 2 * int(near[k].sum() - 1) for k in range(n) if near[k].sum() > 1}
    links = [(a - 5, b - 5) for k, a, b in zip(*found.values()) if k == 1]
    named = [k for k in range(n) if k % 7]
    up = {k: k for k in named}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        assert near[a, b] and a in up and b in up and find(a) != find(b)
        up[find(a)] = find(b)
    assert all(find(a) == find(b) for a in named for b in named if near[a, b])


def test_rows_sent_for_a_near_group(spark, monkeypatch):
    """Rows of the pair step by vector, for a group of near vectors in one label: a few for each table at every size."""
    sent = {}
    real = embed_dedup.linked
    for n in (500, 2000):
        rng = np.random.default_rng(n)
        v = np.ones((n, 16)) + rng.standard_normal((n, 16)) * 0.05
        rows = spark.createDataFrame([(k, x.tolist(), 0, "") for k, x in enumerate(v)], "vec_id long, embedding array<float>, label int, node string")
        spark.sparkContext.setJobGroup("near", "near")
        counted = spark.sparkContext.accumulator(0)

        def counting(threshold):
            run = real(threshold)

            def counted_run(batches):
                def seen():
                    for batch in batches:
                        counted.add(batch.num_rows)
                        yield batch

                return run(seen())

            return counted_run

        monkeypatch.setattr(embed_dedup, "linked", counting)
        assert embed_dedup.near_duplicates(rows).where("n_links > 0").count() > 0
        sent[n] = counted.value / n
    assert sent[2000] <= 1.5 * sent[500], sent


def test_work_follows_the_number_of_rows():
    """More rows have more signs and somewhat more tables; the chance to miss a pair stays."""
    for bits in (8, 14, 30, 60):
        tables = embed_dedup.tables_for(bits, 0.98, 1e-4)
        agree = (1 - math.acos(0.98) / math.pi) ** bits
        assert (1 - agree) ** tables <= 1e-4 < (1 - agree) ** (tables - 1)
    assert embed_dedup.tables_for(30, 0.98, 1e-4) < 70
