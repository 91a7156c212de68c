import hashlib
import random

import public_tokenizers

from loomframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, ids string"


def test_round_trip_and_sharing(spark):
    odd = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "back\\slash \\l <", "", None, "é 漢\U0001F600", " lead\r\n"]
    convs = {}
    for k, t in enumerate(odd):
        convs[k] = [("user", t), ("assistant", odd[-k])]
    convs[20] = [("system", "be kind"), ("user", "hello"), ("assistant", "hi"), ("user", "bye")]
    convs[21] = [("system", "be kind"), ("user", "hello"), ("assistant", "hi")]
    convs[22] = [("system", "be kind"), ("user", "other"), ("assistant", "yes"), ("assistant", "more")]
    convs[23] = convs[20]
    convs[24] = [(None, "no role"), ("a\nb<", "odd role")]
    convs[25] = [("user" if k % 2 else "assistant", f"turn {k}") for k in range(500)]
    rows = [(c, k, r, t, "clash") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", "x", None), (30, None, "user", "first", None), (30, 1, "assistant", "b", None), (30, 1, "assistant", "a", None), (30, 1, "assistant", "a", None)]
    convs[None] = [("user", "x")]
    convs[30] = [("user", "first"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]
    packed = chat.prefix_trees(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = {r.conv_id: r for r in chat.read_back(packed).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        plain = [(r or "", t or "") for r, t in turns]
        assert [(t.role, t.text) for t in got[c].turns] == plain
        assert got[c].loss_text == "".join(t for r, t in plain if r == "assistant")
        assert got[c].formatted == "".join("".join(chat.segments(r, t)) for r, t in plain)
    # what is emitted in one task: each shared turn once, attended to by those after it only
    once = chat.prefix_trees(spark.createDataFrame(rows, SCHEMA).where("conv_id between 20 and 23").coalesce(1).repartition(1)).coalesce(1).collect()
    for row in once:
        for n in row.nodes:
            path, k = [], row.nodes.index(n)
            while k >= 0:
                path.append((row.nodes[k].start, row.nodes[k].start + row.nodes[k].length))
                k = row.nodes[k].parent
            covered = [x for s in n.attends for x in range(s.start, s.end)]
            assert covered == [x for a, b in reversed(path) for x in range(a, b)]
            assert n.position == len(covered) - n.length
    assert sum(len(r.nodes) for r in once) < 4 + 3 + 4 + 4


def test_pieces_equal_whole_text_encoding():
    path = public_tokenizers.path(chat.TOKENIZER)
    rng = random.Random(3)
    parts = ["word", " the", "'s", "'ll", "'", " 12", "3", "é", "Ünter", " ...", "!?", "\n", "\n\n", "  ", " ", "\t", "\r\n", "\\l", "×", "ß", "ǆ", "_", "x" * 60]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(2000)] + ["漢字 and\u00a0more", "\x1c a", "", "e\u0301"]
    known = chat.Pieces(path)
    for at in range(0, len(texts), 300):
        some = texts[at : at + 300]
        for t, ids, whole in zip(some, known.encode(some), chat.encode(path, some)):
            assert ids.tolist() == whole, ascii(t)


def test_one_packer_emits_shared_turns_once():
    packer = chat.Packer(public_tokenizers.path(chat.TOKENIZER))
    packer.add(1, [b"a", b"b"], ["user", "assistant"], ["q", "x"])
    packer.add(2, [b"a", b"c"], ["user", "assistant"], ["q", "y"])
    packer.add(3, [b"a", b"c"], ["user", "assistant"], ["q", "y"])
    packer.end()
    row = packer.batch().to_pylist()[0]
    nodes = row["nodes"]
    assert len(nodes) == 3 and nodes[2]["parent"] == 0 and nodes[2]["position"] == nodes[0]["length"]
    assert nodes[2]["attends"] == [{"start": 0, "end": nodes[0]["length"]}, {"start": nodes[2]["start"], "end": nodes[2]["start"] + nodes[2]["length"]}]
    assert [c["leaf"] for c in row["convs"]] == [1, 2, 2] and len(row["ids"]) == sum(n["length"] for n in nodes)


def test_null_ids_and_long_texts(spark):
    """Rows without a conv_id are conversations of their own; a very long text and many rows are whole."""
    long = "word <|im_end|> [x] " * 100_000
    rows = [(None, k % 2, "user", "same", None) for k in range(30)] + [(None, None, None, None, None), (1, 0, "assistant", long, None), (2, 0, "user", long, None), (2, 1, "assistant", long, None)]
    rows += [(10 + k, t, "user" if t % 2 == 0 else "assistant", f"{'shared ' * 40 if t < 4 else k}", None) for k in range(300) for t in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    packed = chat.prefix_trees(df, most_tokens=2000)
    got = chat.read_back(packed).collect()
    assert len(got) == 31 + 302 and sum(r.conv_id is None for r in got) == 31 and all(len(r.turns) == 1 for r in got if r.conv_id is None)
    by_id = {r.conv_id: r for r in got}
    assert by_id[1].loss_text == by_id[2].loss_text == long and by_id[2].turns[0].text == long
    assert all([t.text for t in by_id[10 + k].turns] == ["shared " * 40] * 4 + [str(k)] * 2 for k in range(300))
    one = packed.selectExpr("size(ids) as n", "size(convs) as c").collect()
    assert sum(r.c for r in one) == len(got) and any(r.c > 1 for r in one)


def test_empty_and_digest(spark):
    assert chat.read_back(chat.prefix_trees(spark.createDataFrame([], SCHEMA))).collect() == []
    assert chat.digest([("user", "a")]) == hashlib.sha256(b"user\na\n").hexdigest()
