import random
import re

import numpy as np
import pytest

from loomframe.llm import mixing

SCHEMA = "doc_id long, text string, source string, n_chars long"


def targets(sizes, weights=mixing.WEIGHTS, most=mixing.MOST):
    """What each source should give, by plain water filling."""
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    out = [0.0] * len(sizes)
    left, open_ = float(sum(sizes)), set(range(len(sizes)))
    while open_:
        unit = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if unit * weight[k] > most * sizes[k]}
        for k in full or open_:
            out[k] = float(most * sizes[k]) if full else unit * weight[k]
        if not full:
            break
        left -= sum(out[k] for k in full)
        open_ -= full
    return out


def test_targets(spark):
    assert targets([100, 100, 100]) == [187.5, 75.0, 37.5]
    got = targets([10, 1000, 1000])
    assert got[0] == 30 and abs(sum(got) - 2010) < 1e-9 and got[1] == 2 * got[2]
    for seed in range(4):
        rng = random.Random(seed)
        sizes = [rng.choice([0, 5, 100, 10**6]) for _ in range(rng.choice([1, 2, 9, 300]))]
        sized = spark.createDataFrame([(f"s{k:05d}", n) for k, n in enumerate(sizes)], "source string, size long").repartition(8)
        rows = mixing.figures_of(sized, mixing.WEIGHTS, 3, 128).orderBy("k").collect()
        assert [r.k for r in rows] == list(range(len(sizes))) and [r.source_size for r in rows] == sizes
        assert np.allclose([r.target for r in rows], targets(sizes), rtol=1e-12)
        assert [r.base for r in rows] == [0, *np.cumsum([r.total for r in rows])[:-1].tolist()]


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64, 1000, 4097])
def test_permutation(size):
    a, b = (mixing.permuted(np.arange(size), size, key) for key in (1, 2))
    assert sorted(a) == sorted(b) == list(range(size)) and (size < 60 or (a != b).any())


@pytest.mark.parametrize("slots", [10**6, 5 * 10**12])
def test_shard_counts_are_a_draw_at_every_size(slots):
    """The sources of any shard's slots: near their shares, and no nearer than a draw would be."""
    share, shards, size = 0.3, 200, 4096
    lo = np.arange(shards)[:, None] * (slots // shards)
    g = (lo + np.arange(min(size, slots // shards))).ravel()
    inverse = np.empty(0)
    # a slot's place among all is the permutation's; its inverse is a permutation as well, so shares are counted forward
    inverse = mixing.permuted(g, slots, 7)
    counts = (inverse.reshape(shards, -1) < share * slots).sum(axis=1)
    n = inverse.size // shards
    spread = np.sqrt(n * share * (1 - share))
    assert abs(counts.mean() - n * share) < 4 * spread / np.sqrt(shards) and 0.8 < counts.std() / spread < 1.2


def rows(seed=0):
    rng = random.Random(seed)
    out = []
    for k in range(400):
        source = "hot" if k % 3 == 0 else rng.choice(["b", "é", None, "zz"])
        out.append((k, "\t".join(f"w{k}-{i}" for i in range(rng.choice([0, 1, 20, 300]))) + " \n", source, 0))
    return out + [(500, None, "b", 0), (501, "one", "tiny", 3), (1, out[1][1], out[1][2], 0), (None, "null id here", "b", 0), (502, "y " * 9000, "long", 0)]


def test_mix(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    mix = mixing.Mix(df)
    got = mix.by_document().collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({r[2] for r in data if r[2]}) + [None]
    sizes = [sum(words(t) for _, t, s, _ in data if s == n) for n in names]
    goal = dict(zip(names, targets(sizes)))
    source = {(d, words(t)): s for d, t, s, _ in data}
    taken = dict.fromkeys(names, 0)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((d is None, d or 0, words(t)) for d, t, _, _ in data)
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[names.index(s)] and abs(r.target - goal[s]) < 1e-9 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - goal[s]) <= 2 * mixing.BLOCK, s
    again = mixing.Mix(df.repartition(5)).by_document().collect()
    order = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(got, key=order) == sorted(again, key=order)
    # every slot of every shard is filled once
    slots = mix.slots.collect()
    assert sorted(r.shard * mixing.SHARD_SLOTS + r.slot for r in slots) == list(range(len(slots)))
    # the texts hold what was taken, in the order of the text
    texts = mix.texts(df).collect()
    held = {}
    for r in texts:
        assert r.n_chars == len(r.text)
        held[r.doc_id] = held.get(r.doc_id, 0) + words(r.text)
    want = {}
    for r in got:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert held == {k: v for k, v in want.items() if v}
    whole = {d: t for d, t, _, _ in data}
    assert all(r.text in whole[r.doc_id] for r in texts)


def test_empty(spark):
    mix = mixing.Mix(spark.createDataFrame([], SCHEMA))
    assert mix.by_document().collect() == [] and mix.texts(spark.createDataFrame([], SCHEMA)).collect() == []
    mix = mixing.Mix(spark.createDataFrame([(1, None, None, None)], SCHEMA))
    assert [(r.size, r.target, r.taken) for r in mix.by_document().collect()] == [(0, 0.0, 0)]


def test_clashing_names_types_and_many_sources(spark):
    rng = random.Random(4)
    data = [(k, f"a{k} b c", f"host{k % 700}", k, rng.random(), "r", k) for k in range(1500)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars int, _mark double, _runs string, _d int")
    mix = mixing.Mix(df, block=4)
    out = mix.texts(df)
    assert out.columns == df.columns and dict(out.dtypes)["n_chars"] == "int"
    whole = {r[0]: r for r in data}
    got = out.collect()
    assert got and all(r["_mark"] == whole[r.doc_id][4] and r["_d"] == r.doc_id and r.n_chars == len(r.text) and r.text in whole[r.doc_id][1] for r in got)
    assert mix.figures.count() == 700


def test_a_row_of_equal_texts_is_chosen_alike(spark):
    data = [(1, "x y z", "s", None, f"l{k}") for k in range(6)]
    schema = "doc_id long, text string, source string, n_chars long, lang string"
    seen = {tuple(sorted(r.lang for r in mixing.Mix(df).texts(df).collect())) for df in (spark.createDataFrame(data, schema), spark.createDataFrame(data[::-1], schema).repartition(3))}
    assert len(seen) == 1
