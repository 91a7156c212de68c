import hashlib
import random
import sys

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from loomframe.llm import bpe
from loomframe.llm.queries import QUERIES


@pytest.fixture(scope="module")
def ranks(spark):
    return bpe.load_ranks(spark, public_tokenizers.path(bpe.RANKS))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def le(ids):
    return b"".join(int(k).to_bytes(4, "little") for k in ids)


ODD = ["", " ", "  a", "a  b \n\n c", "I'll don't I'LL", "x" * 3000, " \t\n" * 500, "éé²½Ⅷ一二", "ࡰ\U000323af\U00010d40 \U0001e5f1x", "<|endoftext|>", "🙂🙂 ok", "a\x00b\x85c", "l'été'sx", "漢字" * 400, "ab" * 2000]


def test_every_code_point_as_the_library(ranks, library):
    """The classes of the pattern: each character between others, basic plane and beyond."""
    words = bpe.Words({}, ranks)
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(chars), 20_000):
        text = "".join(f"a{c} {c}1{c}{c}" for c in chars[at : at + 20_000])
        assert b"".join(map(words.__getitem__, bpe.words_of(text))) == le(library.encode_ordinary(text))


def test_encode_and_decode(spark, ranks, library):
    rng = random.Random(3)
    texts = [None, *ODD, *("".join(rng.choice("aàbc 1.'s\n漢") for _ in range(rng.randrange(80))) for _ in range(200))]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(1, "again", "y"), (1, "again", "y"), (None, "no id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    for slots in (bpe.SLOTS, 4):
        # with four slots nearly all words are folded where they stand
        out = bpe.decode(bpe.encode(df, ranks, keep=["doc_id", "extra", "text"], slots=slots), ranks).collect()
        assert len(out) == len(rows)
        for r in out:
            ids = library.encode_ordinary(r.text or "")
            assert bytes(r.ids) == le(ids) and r.n_tokens == len(ids) and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(df.limit(0), ranks).collect() == []
    with pytest.raises(ValueError):
        bpe.encode(df.withColumnRenamed("extra", "IDS"), ranks, keep=["doc_id", "IDS"])
    with pytest.raises(ValueError):
        bpe.decode(df.withColumnRenamed("extra", "Decoded"), ranks, "text")
    none = spark.createDataFrame([(None,)], "ids binary")
    assert bpe.decode(none, ranks).first().decoded is None


def test_the_fold_is_the_rule(spark, ranks, library):
    """Spark's fold of distinct words, which are all frequent here, by itself."""
    words = [*{w for t in ODD for w in bpe.words_of(t) if 0 < len(w.encode()) <= 64}, " unbelievably", "zzzzzzzzz", "áéíóú"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    folded = df.select("word", bpe.folded(F.col("word"), bpe.rank_map(ranks)).alias("ids"))
    for r in folded.collect():
        assert r.ids == library.encode_ordinary(r.word), r.word
    # the rank map is a literal of the plan, not parsed row by row
    assert "from_json" not in folded._jdf.queryExecution().executedPlan().toString()


def test_frequent_words_are_the_most_frequent(spark, ranks):
    df = spark.createDataFrame([("a b b b c",), (None,), (" b",)], "text string")
    assert {r.word for r in bpe.frequent(df, "text", ranks, 1).collect()} == {" b"}
    assert {(r.word, r.n) for r in bpe.word_counts(df, "text").collect()} == {("a", 1), (" b", 4), (" c", 1)}


def test_refuses_a_vocabulary_without_all_bytes(spark, tmp_path):
    (tmp_path / "few").write_text("YQ== 0\n")
    for path in (f"{tmp_path}/few", f"file://{tmp_path}/few"):
        with pytest.raises(ValueError):
            bpe.load_ranks(spark, path)


def test_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = QUERIES["op11_byte_bpe"](spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(le(ids)).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
