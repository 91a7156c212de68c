import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomframe.llm import langid, quality_qda
from loomframe.llm.queries import QUERIES, fold, table


def test_language_defined_cases(spark):
    rows = [("the thing that the other then", "en"), ("der die das und nicht ein", "de")] * 20 + [(None, "en"), ("", "de"), ("words", None)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["de", "en"]
    df = spark.createDataFrame([(1, "The OTHER thing", 0.1), (2, "NICHT das", 0.1), (3, None, 0.1), (4, "", 0.1), (5, "12 !? 漢 99"[:5], 0.1), (6, "qqq", 0.1), (1, "The OTHER thing", 0.1), (None, "das " * 60000, 0.1)], "doc_id long, text string, score double")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, model).collect()}
    assert got[1][0] == "en" and got[2][0] == got[None][0] == "de" and got[3] == got[4] == got[5] == ("und", 0.0) and got[6] == ("de", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.identify(df.limit(0), model).collect() == []
    empty = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in langid.identify(df, empty).collect()} == {"und"}


def contained(rows, least_share):
    """{language: trigrams that make up least_share of its own}, exactly."""
    grams = {}
    for text, lang in rows:
        if lang is not None:
            grams.setdefault(lang, Counter()).update(plain_trigrams(text))
    return {lang: {g for g, n in c.items() if n / max(1, sum(c.values())) >= least_share} for lang, c in grams.items()}


def plain_trigrams(text):
    clean = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    return [clean[k - 1 : k + 2] for k in range(1, len(clean) - 1) if clean[k] != " "]


@pytest.mark.parametrize("languages", [3, 150])
def test_filter_against_exact_sets(spark, languages):
    """Look-ups give every language that contains a trigram, and hits are the exact ones but for rare false positives."""
    rng = random.Random(languages)
    alphabet = "abcdefghijklmnopqrstuvwxyzäéñ"
    rows = []
    for k in range(languages):
        letters = rng.sample(alphabet, 9)
        rows += [(" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(60)), f"l{k:03d}") for _ in range(3)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string").repartition(4), least_share=1e-3)
    exact = contained(rows, 1e-3)
    assert sorted(model.languages) == sorted(exact)
    texts = [t for t, _ in rows[::7]] + [None, "", "12"]
    n, hits = model.hits(texts)
    extra = total = right = 0
    for i, t in enumerate(texts):
        grams = plain_trigrams(t)
        assert n[i] == len(grams)
        want = [sum(g in exact[lang] for g in grams) for lang in model.languages]
        assert (hits[:, i] >= want).all()
        extra, total = extra + int(hits[:, i].sum()) - sum(want), total + n[i] * len(want)
        if grams:
            best = max(range(len(want)), key=lambda k: (want[k], -k))
            right += model.score([t])[0][0] == model.languages[best]
    assert extra <= 0.001 * total and right >= 0.98 * (len(texts) - 3)


def test_op8_against_exact_sets(spark, sf_dir):
    """The registered query against a plain version with exact sets and no filter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    taught = [(d.text, d.lang) for d in docs if zlib.crc32(str(d.doc_id).encode()) % 3 != 1]
    exact = contained(taught, langid.LEAST_SHARE)
    order = sorted(exact, key=lambda lang: (-sum(x == lang for _, x in taught), lang))
    got = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        grams = plain_trigrams(d.text)
        share = [sum(g in exact[lang] for g in grams) / max(1, len(grams)) for lang in order]
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1)
        assert r.lang_pred == (order[share.index(max(share))] if grams else "und") and abs(r.score - max(share)) < 0.01


def test_language_names_clash(spark):
    model = langid.Model([], np.zeros((1, 8), np.uint64))
    with pytest.raises(ValueError):
        langid.identify(spark.createDataFrame([(1, "a", 0.5)], "doc_id long, text string, score double"), model, keep=("doc_id", "score"))


def test_language_held_out(spark, sf_dir):
    got = QUERIES["op8_language_id"](spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    row = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count(F.lit(1)).alias("n")).first()
    assert row.n > 30 and row.a > 0.95


def test_quality_classifier(spark, sf_dir):
    got = QUERIES["op9_quality_classifier"](spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out").toPandas()
    assert len(got) > 40 and (got.predicted == got.quality).mean() > 0.95 and ((got.score >= 0.3) == (got.predicted == 1)).all()


def plain_statistics(text):
    """The twelve statistics by hand, word by word and line by line."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    each = len(words) + 12
    rate = lambda chars: sum(c in chars for c in text) / each
    filled = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    opened = sum(x.strip(" \t\r\x0b\x0c")[-1] not in ".!?:;\"')" for x in filled)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    again = (len(grams) - len(set(grams))) / each if len(words) > 3 else 0
    distinct = (len(set(words)) + 12) / each if words else 1
    return [
        math.log1p(len(words)), math.log1p((sum(map(len, words)) + 60) / each), *(math.sqrt(rate(c)) for c in ("#*$%&<>", "|", "!?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:")),
        math.sqrt(again), distinct, math.sqrt(opened / (len(filled) + 1)), math.log1p(max(10, max(map(len, words), default=0))),
    ]


def test_op9_by_hand(spark, sf_dir):
    """The registered query: statistics, shrunken covariances and densities written out, without the module's own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    x = np.array([plain_statistics(d.text) for d in docs])
    y = np.array([labels[d.doc_id] if d.doc_id in labels and zlib.crc32(str(d.doc_id).encode()) % 5 else -1 for d in docs])
    groups = [x[y == k] for k in (0, 1)]
    covariances = [np.cov(g.T, bias=True) for g in groups]
    taught = x[y >= 0]
    pooled = sum(len(g) * c for g, c in zip(groups, covariances)) / len(taught)
    scale = np.sqrt(np.maximum(taught.var(axis=0), 1e-6))
    log_density = []
    for g, c in zip(groups, covariances):
        shrunk = (0.9 * c + 0.1 * pooled) / np.outer(scale, scale)
        shrunk = 0.9 * shrunk + 0.1 * np.eye(12)
        z = (x - g.mean(axis=0)) / scale
        log_density.append(math.log(len(g) / len(taught)) - 0.5 * np.linalg.slogdet(shrunk)[1] - 0.5 * np.einsum("ni,ij,nj->n", z, np.linalg.inv(shrunk), z))
    want = 1 / (1 + np.exp(np.clip(log_density[0] - log_density[1], -500, 500)))
    got = {r.doc_id: r for r in QUERIES["op9_quality_classifier"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d, w in zip(docs, want):
        assert abs(got[d.doc_id].score - w) < 1e-6 and got[d.doc_id].predicted == int(got[d.doc_id].score >= 0.3)
        assert got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)


def test_statistics_do_not_depend_on_batches():
    texts = ["A line.\nAnother one here!\n\n", None, "", "x### y%%%", "UP!! UP!!", "é " * 40000, " . ", "a | b | c", "same same same same same"]
    whole = quality_qda.statistics(pa.array(["first", *texts]).slice(1))
    for k, t in enumerate(texts):
        assert np.allclose(whole[k], quality_qda.statistics(pa.array([t], pa.string()))[0])
    assert quality_qda.statistics(pa.array([], pa.string())).shape == (0, len(quality_qda.NAMES)) and np.isfinite(whole).all()


def test_quality_defined_cases(spark):
    docs = spark.createDataFrame([(k, f"some words of text number {k} and more.", "x") for k in range(30)] + [(40, None, "x"), (41, "", "x"), (None, "a", "x"), (1, "a", "x")], "doc_id long, text string, y string")
    features = quality_qda.featured(docs)
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, 7)], "doc_id long, quality int")
    both = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(1, 1), (None, 1)], "doc_id long, quality int")
    for labels, want in ((none, {0.5}), (one, {1.0}), (both, None)):
        got = quality_qda.scored(features, quality_qda.fit(features, labels)).collect()
        assert len(got) == 34 and all(0 <= r.score <= 1 for r in got) and (want is None or {r.score for r in got} == want)
    assert quality_qda.scored(quality_qda.featured(docs.limit(0)), quality_qda.fit(features, both)).collect() == []
    assert fold("doc_id", 3) is not None
