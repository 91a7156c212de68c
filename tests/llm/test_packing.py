import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomframe.llm import packing

SCHEMA = "doc_id long, text string, length string"


def best_fit(lengths, size):
    """Sequential best-fit decreasing: the number of sequences."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            g = min(fit)
            gaps[gaps.index(g)] = g - n
        else:
            gaps.append(size - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 64, 200])
    lengths = [min(size, int(rng.expovariate(4 / size)) + 1) for _ in range(rng.choice([1, 50, 1500]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    held, placed = {}, {n: [] for n in counts}
    for length, rank, n, first, offset in packing.plan(counts, size):
        placed[length].append((rank, n))
        for s in range(first, first + n):
            assert held.get(s, 0) == offset
            held[s] = offset + length
    assert max(held.values()) <= size and set(held) == set(range(len(held)))
    for length, parts in placed.items():
        assert [r for r, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) == counts[length]
    assert len(held) == best_fit(lengths, size)


def test_plan_has_one_size_at_every_scale():
    """The plan follows the lengths there are, not how many pieces have them; few sequences more than the tokens need."""
    rng = np.random.default_rng(0)
    lengths, counts = np.unique(np.minimum(2048, rng.lognormal(5.5, 1.2, 50_000).astype(int) + 1), return_counts=True)
    sizes = []
    for times in (1, 1000, 10**6):
        plan = packing.plan({int(n): int(c) * times for n, c in zip(lengths, counts)}, 2048)
        made = max(first + n for _, _, n, first, _ in plan)
        assert made <= 1.001 * int((lengths * counts).sum()) * times / 2048 + 1
        sizes.append(len(plan))
    assert max(sizes) < 1.5 * min(sizes) < 60_000


def test_encoder_equals_whole_text_encoding():
    path = public_tokenizers.path(packing.TOKENIZER)
    texts = ["It's  a Test.\n\nUN’été été", None, "", "<|endoftext|> x<|startoftext|>y", "漢字　ok  12345", "\x00 a\x1cb", "don't I'LL", "́ a", " " * 9]
    ends, ids = packing.Encoder(path).encode(pa.array(["skip", *texts]).slice(1))
    whole = Tokenizer.from_file(path)
    lo = 0
    for t, hi in zip(texts, ends.tolist()):
        assert ids[lo:hi].tolist() == whole.encode(t or "", add_special_tokens=False).ids, t
        lo = hi


def test_every_two_byte_letter_before_closing_marks():
    """U+00C0 to U+024F, alone and after a letter, before each closing mark and some in a row; then mixed texts."""
    path = public_tokenizers.path(packing.TOKENIZER)
    texts = [f"{head}{chr(code)}{tail} next" for code in range(0xC0, 0x250) for head in ("", "a", "A\u0301") for tail in (*".,!?;:", "...", "?!", ".'", "'.")]
    rng = random.Random(8)
    alphabet = "aZ9.,!?;:' \n'\u0130\u0131\u00df\u0149\u01c5\u00e9\u0301\u0307\u03a3\u1e9e\ufb01\u6f22<|>"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    whole = Tokenizer.from_file(path)
    known = packing.Encoder(path)
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        ends, ids = known.encode(pa.array(some))
        lo = 0
        for t, hi in zip(some, ends.tolist()):
            assert ids[lo:hi].tolist() == whole.encode(t, add_special_tokens=False).ids, ascii(t)
            lo = hi


def test_pack(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["thing", "of", "a", "réel", "xq"]) for _ in range(rng.choice([0, 3, 30, 300, 900])))) for k in range(300)]
    rows += [(400, None), (401, "the " * 5000), (7, "again"), (7, "again"), (None, "null id")]
    got = packing.pack(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), 2048):
            part = ids[p : p + 2048]
            want.append((d, p // 2048, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    held = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 2048 and len(held) == best_fit([w[3] for w in want], 2048)
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_plan_makes_as_many_sequences_as_row_wise_best_fit():
    from loomframe.llm.packing import plan

    rng = random.Random(3)
    for lengths in [[4, 4, 4, 4, 3, 3, 2], *([rng.randrange(1, 13) for _ in range(rng.randrange(1, 60))] for _ in range(300))]:
        gaps = []
        for n in sorted(lengths, reverse=True):
            best = min((g for g in gaps if g >= n), default=None)
            gaps.append((12 if best is None else gaps.pop(gaps.index(best))) - n)
        got = plan(dict(Counter(lengths)), 12)
        spots = [(s, o, n) for n, _, k, first, o in got for s in range(first, first + k)]
        used = Counter()
        for s, o, n in sorted(spots):
            assert used[s] == o
            used[s] += n
        assert sorted(n for _, _, n in spots) == sorted(lengths) and sorted(12 - u for u in used.values()) == sorted(gaps)
