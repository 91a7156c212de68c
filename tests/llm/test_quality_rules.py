from collections import Counter

import duckdb
import pytest

from loomframe.llm import quality_rules
from loomframe.llm.sql import OP1_SQL

SCHEMA = "doc_id long, text string, lang string"
PROSE = "\n".join(" ".join(f"word{k * 13 + j}" for j in range(12)) + "." for k in range(12))


def brute(text):
    words = (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\v\f")]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def judged(spark, rows):
    return {r.doc_id: r for r in quality_rules.clean_lines(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_counts_and_verdicts(spark):
    texts = [PROSE, None, "", " \n\t", "a b c a b c a b c a b c a b c", "x " * 30000, PROSE + "\nHome | About | Contact\nwe use javascript here.", "\n".join(["w1&&& w2### w3*** w4$$$ w5%%%."] * 3 + [f"q{k}&&&" for k in range(9)]), " é ü\U0001F600 z", "Home | News | Shop | Help | More\n" * 9]
    found = judged(spark, [(k, t, None) for k, t in enumerate(texts)])
    for k, t in enumerate(texts):
        r = found[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), k
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert found[0].kept and found[0].clean_text == PROSE
    assert found[6].kept and found[6].clean_text == PROSE and found[6].n_failed_lines == 2
    assert not any(found[k].kept for k in (1, 2, 3, 4, 5, 7, 8, 9)) and found[1].clean_text is None


def test_stock_phrases_stand_alone(spark):
    """A phrase inside longer words is prose; in four languages a line that holds one goes."""
    prose = ["The catalog in the old library was a sign upon the door of readmore.", "Ein weblog in vielen Teilen, mehrlesen und datenschutzerklärungen gibt es."]
    stock = ["Please log in.", "Log in: now.", "(Privacy Policy).", "Todos los derechos reservados.", "Lea la Política de Privacidad.", "Tous droits réservés.", "Voir les Conditions d'utilisation.", "Alle Rechte vorbehalten.", "Unsere Datenschutzerklärung."]
    found = judged(spark, [(k, f"{PROSE}\n{line}", None) for k, line in enumerate(prose + stock)])
    assert [found[k].n_failed_lines for k in range(len(found))] == [0] * len(prose) + [1] * len(stock)


def test_sql_says_the_same(spark):
    texts = [PROSE, None, "", "We log in.\nTodos los derechos reservados.\nblog in here.\n" + PROSE, "Home | A | B\nok then !!\nmehr lesen.\n" * 3, "é ü — Tous droits réservés.\nLire la suite…\nx\u00a0log in\u00a0y."]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar)")
    con.executemany("insert into documents values (?, ?, null)", list(enumerate(texts)))
    want = {r["doc_id"]: r for r in con.sql(OP1_SQL).fetchdf().to_dict("records")}
    for k, r in judged(spark, [(k, t, None) for k, t in enumerate(texts)]).items():
        for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", "n_failed_lines"):
            assert r[c] == want[k][c], (k, c)


def test_empty_repeated_and_clashing(spark):
    assert judged(spark, []) == {}
    twice = quality_rules.clean_lines(spark.createDataFrame([(1, PROSE, "en")] * 2, SCHEMA)).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    clash = spark.createDataFrame([(1, PROSE, True)], "doc_id long, text string, kept boolean")
    with pytest.raises(ValueError):
        quality_rules.clean_lines(clash)
    assert quality_rules.clean_lines(clash, prefix="q_").collect()[0].q_kept


def test_no_shuffle_or_python(spark):
    plan = quality_rules.clean_lines(spark.createDataFrame([(1, PROSE, "en")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
