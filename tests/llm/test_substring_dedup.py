import random

import pytest
from pyspark.sql import functions as F

from loomframe.llm import substring_dedup as S

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least=25):
    first = {}
    for d, t in sorted(((d, t) for d, t in rows if d is not None and t), key=lambda x: x[0]):
        for k, f in enumerate(S.units(t)[1]):
            if f:
                first[f] = min(first.get(f, (d, k)), (d, k))
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, []))
            continue
        forms = S.units(t)[1]
        again = {k for k, f in enumerate(forms) if f and d is not None and first[f] != (d, k)}
        clean, spans, *_ = S.cut(t, again, least)
        out.append((d, clean, spans))
    return out


def corpus():
    rng = random.Random(8)
    sentence = lambda: " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(rng.randrange(3, 14))) + rng.choice(".!?")
    passage = " ".join(sentence() for _ in range(8)) + "\n" + sentence()
    stock = "All rights are kept here."
    rows = []
    for k in range(60):
        parts = [sentence() for _ in range(rng.randrange(1, 20))]
        if k % 4 == 0:
            parts.insert(rng.randrange(len(parts)), passage.upper() if k % 8 else passage)
        if k % 3 == 0:
            parts.append(stock)
        rows.append((k, rng.choice([" ", "\n", " \n "]).join(parts)))
    return rows, passage, stock


def test_against_brute_force(spark):
    rows, passage, stock = corpus()
    rows += [(100, None), (101, ""), (102, " \n \n"), (None, passage), (103, passage), (103, passage), (104, passage + "\n" + passage), (105, "word " * 40000)]
    got = S.dedup_substrings(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(((r.doc_id, r.clean_text, [(s.start, s.end) for s in r.spans]) for r in got), key=key) == sorted(brute(rows), key=key)
    by_id = {r.doc_id: r for r in got}
    assert passage in by_id[0].clean_text and by_id[104].n_removed and by_id[None].clean_text == passage and by_id[100].clean_text is None
    for r in got:
        if r.text is not None:
            rest, at = [], 0
            for s in r.spans:
                rest.append(r.text[at : s.start])
                at = s.end
            assert "".join([*rest, r.text[at:]]) == r.clean_text
    for k in range(4, 60, 4):
        assert passage.split(".")[0].lower() not in by_id[k].clean_text.lower()
    for k in range(0, 60, 3):
        assert stock in by_id[k].clean_text or by_id[k].removed_words
    for k in range(60):
        if k % 4:
            assert by_id[k].clean_text == by_id[k].text


def test_empty_and_clash(spark):
    assert S.dedup_substrings(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        S.dedup_substrings(spark.createDataFrame([], "doc_id long, text string, Spans int"))


def test_columns_with_the_names_of_its_own_steps(spark):
    more = ["_mark", "_places", "_id", "_key", "_of", "_covers", "row", "key", "of", "places", "covers", "mark", "h1", "place"]
    line = " ".join(f"w{k}" for k in range(30)) + "."
    df = spark.createDataFrame([(k, f"own {k}.\n{line}", *range(len(more))) for k in range(2)], ", ".join(["doc_id long", "text string", *[f"{c} long" for c in more]]))
    for anywhere in (False, True):
        out = S.dedup_substrings(df, anywhere=anywhere).orderBy("doc_id").collect()
        assert [r.removed_words for r in out] == [0, 30] and out[0].clean_text == df.first().text
        assert all([r[c] for c in more] == list(range(len(more))) for r in out)
    # the id and the text may have other names, and be all there is
    bare = df.select(F.col("doc_id").alias("key"), F.col("text").alias("of"))
    assert sorted(r.removed_words for r in S.dedup_substrings(bare, "key", "of").collect()) == [0, 30]


def test_unlike_texts_under_one_id(spark):
    rng = random.Random(5)
    part = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(9)) + "."
    first = [part() for _ in range(6)]
    own = [part() for _ in range(6)]
    rows = [(1, " ".join(first)), (2, " ".join([part(), *first[2:]])), (2, " ".join(own))]
    got = S.dedup_substrings(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)).collect()
    assert sorted((r.doc_id, r.clean_text) for r in got) == sorted((d, c) for d, c, _ in brute(rows))
    assert " ".join(own) in {r.clean_text for r in got} and sum(r.n_removed for r in got) == 4


def by_words(rows, least=25):
    """Clean texts by a dictionary of all windows and one of all units."""
    unit, window, out = {}, {}, []
    for d, t in sorted(rows):
        forms = S.units(t)[1]
        again = {k for k, f in enumerate(forms) if f and unit.setdefault(f, (d, k)) != (d, k)}
        words, seen, covers = t.lower().split(), {}, []
        for i in range(len(words) - least + 1):
            w = tuple(words[i : i + least])
            at, head = seen.get(w, (-least, i))
            seen[w] = (i, head) if i - at < least else (i, i)
            if window.setdefault(w, (d, seen[w][1])) != (d, seen[w][1]):
                covers.append((i, 1))
        out.append((d, S.cut_words(t, again, covers, least)[0]))
    return out


def test_passages_in_mid_sentence(spark):
    rng = random.Random(9)
    some = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    sentences = " ".join(some(n) + "." for n in (29, 12, 12))
    bare = some(60)
    rows = [(1, sentences + " " + some(5) + "."), (2, some(40) + " " + sentences + " " + some(30))]
    rows += [(3, bare), (4, some(7) + " " + bare.upper() + " " + some(7)), (5, some(9) + "\n" + bare[bare.index(" ", 200) :] + "\t" + some(9))]
    rows += [(6, some(3) + " " + " ".join(bare.split()[:24]) + " " + some(3)), (7, "word " * 900), (8, some(4) + " word" * 300), (9, bare + " x " + bare)]
    for k in range(10, 60):
        cuts = sorted(rng.randrange(61) for _ in range(2))
        rows.append((k, " ".join([some(rng.randrange(30)), *bare.split()[cuts[0] : cuts[1]], some(rng.randrange(30)), rng.choice([sentences, bare, some(20)]), some(5)])))
    got = {r.doc_id: r for r in S.dedup_substrings(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA), anywhere=True).collect()}
    for d, clean in by_words(rows):
        assert got[d].clean_text == clean, d
    assert not set(sentences.split()) & set(got[2].clean_text.split()) and got[2].removed_words == 53
    assert got[1].clean_text == got[1].text and got[3].clean_text == bare and got[6].n_removed == 0 and got[7].n_removed == 0
    assert got[4].removed_words == 60 and got[8].removed_words == 300 and got[9].removed_words == 120


def test_passages_anywhere_of_the_given_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.clean_text) for r in S.dedup_substrings(docs, anywhere=True).collect())
    assert got == by_words(rows)
