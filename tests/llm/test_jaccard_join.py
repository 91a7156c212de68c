import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomframe.llm import jaccard_join as J
from loomframe.llm.components import components

SCHEMA = "doc_id long, text string, component_id string"


def brute(rows, width=5, percent=80):
    """{(doc_id, text): (n, component)} by comparing all pairs."""
    sets = []
    for d, t in rows:
        w = [x.lower() for x in (t or "").encode().split()]
        s = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        sets.append((d, s))
    up = {d: d for d, _ in rows if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {(d, t): (len(s), find(d) if d is not None else None) for (d, t), (_, s) in zip(rows, sets)}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    shared = " ".join(word() for _ in range(60))
    rows, k = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 6, 40, 120, 400]))]
        for _ in range(rng.choice([1, 1, 3, 8])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                w[rng.randrange(len(w))] = word()
            text = " ".join(w)
            if rng.random() < 0.4:
                text += "\n" + shared
            rows.append((k, text.upper() if rng.random() < 0.2 else text))
            k += 1
    return rows


@pytest.mark.parametrize("hot", [2, 1000])
def test_against_brute_force(spark, hot):
    rows = corpus(hot) + [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "a c"), (906, "É a b c d e"), (907, "é a b c d e"), (None, "a b"), (903, "a b"), (950, "x y " * 9000)]
    want = brute(rows)
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    got = J.jaccard_join(df, hot=hot).select("doc_id", "n_shingles", "component_id").collect()
    assert len(got) == len(rows)
    by_id = {d: v for (d, _), v in want.items()}
    for r in got:
        assert (r.n_shingles, r.component_id) == by_id[r.doc_id], r


def test_large_groups_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 8)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(k % 4):
            w[rng.randrange(200)] = f"e{k}{rng.random()}"
        rows.append((k, " ".join(w)))
    want = {d: c for (d, _), (_, c) in brute(rows).items()}
    got = {r.doc_id: r.component_id for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_empty(spark):
    assert J.jaccard_join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tree_prunes_no_similar_pair():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(8):
        base = rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64)
        for _ in range(9):
            sets.append(np.unique(np.where(rng.random(len(base)) < 0.06, rng.integers(0, 1 << 63, len(base), dtype=np.uint64), base)))
    n = np.array([len(s) for s in sets])
    bits = [J.signature(s) for s in sets]
    similar = {(b, a) for a in range(len(sets)) for b in range(a) if 100 * (c := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (n[a] + n[b] - c)}
    i, j = J.candidates(n, n, bits, np.full(len(n), J.BOTH), 80)
    left = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    assert len(left) == len(i) < len(sets) * (len(sets) - 1) // 2 // 3
    assert similar <= left
    role = np.where(np.arange(len(n)) % 3 == 0, J.LEFT, J.RIGHT)
    i, j = J.candidates(n, n, bits, role, 80)
    assert (role[i] == J.LEFT).all() and (role[j] == J.RIGHT).all()
    assert {p for p in similar if role[p[0]] != role[p[1]]} <= {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}


def near_copies(n, seed=7):
    """n texts of 150 words, each with one to three words of its own."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(150)]
    out = []
    for k in range(n):
        w = list(base)
        for e in range(rng.choice([1, 1, 2, 3])):
            w[rng.randrange(150)] = f"own{k}x{e}"
        out.append((k, " ".join(w)))
    return out


def test_rows_grow_with_the_group(spark, monkeypatch):
    """Rows of each round by the members of a group of near copies: in proportion, not with the square."""
    made = {}

    def kept(df, name):
        out = written(df, name)
        if name == "pruned":
            made.setdefault("pruned", []).append(out.count())
        return out

    from loomframe.llm.common import written

    monkeypatch.setattr(J, "written", kept)
    share = {}
    for n in (500, 1500, 3000):
        made.clear()
        rows = near_copies(n)
        got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).select("doc_id", "component_id").collect()
        share[n] = sum(made["pruned"]) / n
        if n == 500:
            want = {d: c for (d, _), (_, c) in brute(rows).items()}
            assert {r.doc_id: r.component_id for r in got} == want
    assert share[3000] < 1.5 * share[500], share


def test_rows_sent_follow_the_members(spark):
    """What a pivot left of one tree of long texts without a link: rows sent to the bitmaps' round by member."""
    sent = {}
    for n in (1000, 2000, 4000, 8000):
        members = spark.range(n).select(F.lit(1).cast("long").alias("token"), F.lit(n).cast("long").alias("size"), F.lit(9).alias("parts"), F.col("id").alias("node"), F.lit(20_000).cast("long").alias("n"), F.lit(20_000).cast("long").alias("reach"))
        none = spark.createDataFrame([], J.MEMBER)
        rows = J.last_rows(members, none, spark.createDataFrame([], "node long, token long"), spark.createDataFrame([], "node long, component long"))
        sent[n] = rows.count() / n
    assert max(sent.values()) <= 8 and sent[8000] <= 1.1 * sent[1000], sent


def test_groups_dealt_again(spark, monkeypatch):
    """Whole sets in small parts: every pair of the two sides still meets, and the links are those of brute force."""
    monkeypatch.setattr(J, "CHUNK_SHINGLES", 700)
    columns = [range(90), [J.LEFT if k < 30 else J.RIGHT for k in range(90)]]

    def group(token, lo, hi, nodes, roles, whole):
        n = len(nodes)
        made = {"token": [token] * n, "lo": pa.array([lo] * n, pa.int32()), "hi": pa.array([hi] * n, pa.int32()), "node": list(nodes), "role": pa.array(roles, pa.int32()), "size": [n] * n, "whole": [whole] * n}
        return pa.table(made | {"reach": [50] * n, "comp": list(nodes), "pick": pa.nulls(n, pa.int64())}).select(J.NAMES)

    out = [r for g in (group(1, 2, 3, *columns, False), group(2, 0, 0, range(9), [J.BOTH] * 9, True)) for b in J.dealt_again(g, np.full(g.num_rows, 50)) for r in b.to_pylist()]
    groups = {}
    for r in out:
        groups.setdefault((r["token"], r["lo"], r["hi"]), {}).setdefault(r["role"], set()).add(r["node"])
    met = [(a, b) for (t, *_), g in groups.items() if t == 1 for a in g.get(J.LEFT, ()) for b in g.get(J.RIGHT, ())]
    assert sorted(met) == [(a, b) for a in range(30) for b in range(30, 90)]
    assert [g for k, g in groups.items() if k[0] == 2] == [{J.BOTH: set(range(9))}]
    assert max(sum(map(len, g.values())) for k, g in groups.items() if k[0] == 1) < 60
    monkeypatch.setattr(J, "CHUNK", 8)
    docs = near_copies(60, 5) + [(100 + k, t) for k, t in corpus(7)[:80]]
    want = {d: c for (d, _), (_, c) in brute(docs).items()}
    got = J.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), hot=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_shared_ids(spark):
    """Unlike texts of one doc_id are one document, with the links of each."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (9, b + " more"), (5, ""), (7, c), (7, "x y"), (8, "x y"), (6, None), (6, c)]
    want = {3: 3, 5: 3, 9: 3, 7: 6, 8: 6, 6: 6}
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] for r in got)


def test_shared_ids_in_hot_trees(spark, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 8)
    rng = random.Random(11)
    rows = [(rng.randrange(40), t) for _, t in near_copies(60, 3)] + [(rng.randrange(40), t) for _, t in corpus(5)[:60]]
    want = {d: c for (d, _), (_, c) in brute(rows).items()}
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), hot=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, rng.randrange(1000, 1400)) for _ in range(300)] + [(5000, 5000), (7000, 6000), (6000, 7000)]
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    want = {x: find(x) for e in edges for x in e if find(x) != x}
    shuffled = edges[:]
    rng.shuffle(shuffled)
    got = components(spark.createDataFrame(shuffled, "x long, y long").repartition(8)).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "x long, y long")).collect() == []
