import numpy as np
import pyarrow as pa

from loomframe.llm import common


def test_words_of_sliced_arrays():
    texts = ["É è\tÜber", None, "", " \x0b\f ", "a  b\r\nc d", "last ñ"] * 3
    whole = pa.array(texts)
    for lo, n in ((0, 18), (1, 5), (7, 9), (17, 1), (3, 0)):
        offsets, words = common.split_words(whole.slice(lo, n))
        assert len(offsets) == n + 1
        for k in range(n):
            want = [w.decode() for w in (texts[lo + k] or "").encode().split()]
            assert words.slice(offsets[k], offsets[k + 1] - offsets[k]).to_pylist() == want


def test_sliced_keeps_every_row():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 50, None, "y" * 500, "z", ""] * 4, "k": list(range(20))})
    parts = list(common.sliced(iter([batch]), "text", 120))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(20))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 120 for p in parts)


def test_by_group_over_batches():
    batches = [pa.RecordBatch.from_pydict({"k": np.array(ks)}) for ks in ([1, 1, 2], [2, 2], [], [3], [3, 4])]
    seen = []
    work = common.by_group(["k"], None, lambda g: seen.append(g["k"].to_pylist()))
    assert list(work(iter([b for b in batches if b.num_rows] + [batches[2].slice(0, 0)]))) == []
    assert seen == [[1, 1], [2, 2, 2], [3, 3], [4]]
