"""The pipeline's stages against brute force over a small corpus, and its odd rows."""

import math
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from test_jaccard_join import brute as near_classes
from test_packing import best_fit
from test_substring_dedup import brute as cut_rows
from tokenizers import Tokenizer

import corpus_pipeline as P
from loomframe.llm import mixing, quality_qda
from loomframe.llm.common import written
from loomframe.session import shared_dir
from loomframe.llm.mixing import WORD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return len(WORD.findall(text or ""))


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()), key=str)


def test_each_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*P.COLUMNS)
    raw = rows_of(docs)

    # quality: moments and scores by hand from all training labels
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    x = quality_qda.statistics(pa.array([r[1] for r in raw], pa.string()))
    y = np.array([labels.get(r[0], -1) for r in raw])
    sums = [(np.count_nonzero(y == k), x[y == k].sum(axis=0), x[y == k].T @ x[y == k]) for k in (0, 1)]
    score = quality_qda.Model(*(np.array([s[i] for s in sums]) for i in range(3))).score(x)
    good = [r for r, s in zip(raw, score) if s >= 0.3]
    state = written(P.quality(spark, docs, sf_dir), "test")
    assert rows_of(state) == sorted(good, key=str) and len(good) < len(raw)

    # near duplicates: all pairs compared
    classes = near_classes([(r[0], r[1]) for r in good])
    first = [r for r in good if not classes[r[0], r[1]][0] or classes[r[0], r[1]][1] == r[0]]
    state = written(P.near_dups(spark, state, sf_dir), "test")
    assert rows_of(state) == sorted(first, key=str) and len(first) < len(good)

    # repeats: every unit's first occurrence by a dictionary
    clean = {d: (t, s) for d, t, s in cut_rows([(r[0], r[1]) for r in first])}
    rest = [(r[0], clean[r[0]][0], r[2], r[3], len(clean[r[0]][0]) if clean[r[0]][1] else r[4]) for r in first if words(clean[r[0]][0]) or not clean[r[0]][1]]
    state = written(P.repeats(spark, state, sf_dir), "test")
    assert rows_of(state) == sorted(rest, key=str)

    # mixture: the blocks that each source's passes and permutations name, from its stream in order
    mix = mixing.Mix(state)
    keyed = mix.sized.select("doc_id", "mark", P.F.xxhash64("doc_id", "mark", P.F.lit(1)).alias("place"), P.F.xxhash64("doc_id", "mark").alias("deal"))
    order = {(r.doc_id, r.mark): (r.deal, r.place) for r in keyed.collect()}
    mark = {r.doc_id: r.mark for r in mix.sized.collect()}
    assert len(mark) == len(rest)
    want = {}
    for f in mix.figures.orderBy("k").collect():
        k, source = f.k, f.source
        of_source = [r for r in rest if r[3] == source]
        buckets = max(1, math.isqrt(len(of_source)))
        own = sorted((order[r[0], mark[r[0]]][0] % buckets, order[r[0], mark[r[0]]][1], r[0], words(r[1])) for r in of_source)
        stream = [(d, i) for _, _, d, n in own for i in range(n)]
        n = f.blocks
        slots = [r for r in mix.slots.where(f"k = {k}").collect()]
        assert abs(len(slots) - f.target * n / max(1, f.source_size)) <= 1
        for turn in {r.turn for r in slots}:
            got = sorted(r.block for r in slots if r.turn == turn)
            count = min(n, len(slots) - turn * n)
            key = mixing.SEED * 1_000_003 + k * 101 + turn
            assert got == sorted(mixing.permuted(np.arange(count), n, key).tolist())
        for r in slots:
            for d, i in stream[r.block * mixing.BLOCK : (r.block + 1) * mixing.BLOCK]:
                want.setdefault(d, []).append((r.turn, i))
    spans = {r[0]: [m.span() for m in WORD.finditer(r[1] or "")] for r in rest}
    whole = {r[0]: r for r in rest}
    mixed = []
    for d, taken in want.items():
        taken.sort()
        runs = []
        for turn, i in taken:
            if runs and runs[-1][0] == turn and runs[-1][2] == i - 1:
                runs[-1][2] = i
            else:
                runs.append([turn, i, i])
        for _, a, b in runs:
            t = whole[d][1][(spans[d][a][0] if a else 0) : (spans[d][b][1] if b + 1 < len(spans[d]) else None)]
            mixed.append((d, t, whole[d][2], whole[d][3], len(t)))
    state = written(P.mixture(spark, state, sf_dir), "test")
    assert rows_of(state) == sorted(mixed, key=str)

    # packing: ids of whole texts, as few sequences as row-wise best fit
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = []
    for d, t, *_ in mixed:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        pieces += [(d, p // 2048, p, len(part := ids[p : p + 2048]), zlib.crc32(np.array(part, "<u4").tobytes())) for p in range(0, len(ids), 2048)]
    got = P.pack(spark, state, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(pieces)
    held = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 2048 and len(held) == best_fit([p[3] for p in pieces], 2048)


def test_odd_rows(spark, sf_dir):
    rng = random.Random(3)
    prose = " ".join(f"plain{rng.randrange(10**6)} word" for k in range(80)) + "."
    rows = [(1, prose, "en", "a", None), (1, prose, "en", "a", None), (2, prose, None, None, 5), (None, prose + " x", "en", "b", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (5, "tiny text", "en", "c", 9), (6, "long " * 200_000, "en", "d", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    near = P.near_dups(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in near) == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 6), (True, 0)]
    # unlike texts of one doc_id are told apart; of near copies the first stays, whoever's they are
    other = " ".join(f"other{k}" for k in range(60))
    shared = spark.createDataFrame([(3, prose, "en", "a", 1), (5, prose, "en", "a", 1), (5, other, "en", "a", 1), (9, other + " x", "en", "a", 1), (5, other + " y", "en", "a", 1)], SCHEMA)
    near = P.near_dups(spark, shared, sf_dir).collect()
    assert len(near) == 2 and {r.doc_id for r in near} == {3, 5} and {r.text[:5] for r in near} == {"plain", "other"}
    for name, stage in P.STAGES:
        assert stage(spark, docs, sf_dir).columns == (P.COLUMNS if name != "packing" else ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
        assert stage(spark, docs, sf_dir).collect() is not None
        assert stage(spark, docs.limit(0), sf_dir).collect() == []


def test_run_and_contract(spark, sf_dir):
    assert [n for n, _ in P.STAGES] == ["quality", "near_dups", "repeats", "mixture", "packing"] and P.ORACLE_SQL is None
    folder = Path(shared_dir(spark).removeprefix("file://")) / "loomframe"
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    assert P.run(spark, sf_dir).count() > 0
    # What is left is the last stage's table.
    assert [n.rsplit("-", 1)[0] for n in {p.name for p in folder.iterdir()} - before] == ["stage-packing"]
