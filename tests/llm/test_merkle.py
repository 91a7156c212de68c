import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from loomframe.llm import merkle
from loomframe.llm.queries import QUERIES, SQL
from tests.compare import assert_same, connect


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """(root, by leaf its siblings by level): all levels of one tree, as the contract says it."""
    paths = [[] for _ in nodes]
    places = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(places):
            run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
            paths[k].append((at % 8, run[: at % 8] + run[at % 8 + 1 :]))
            places[k] = at // 8
        nodes = [sha("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    """Sorted (id, leaf, subroot, root, proof, folded root) of rows (id, key, text)."""
    trees = {}
    for r in rows:
        trees.setdefault("" if r[1] is None else ":" + r[1], []).append(r)
    done, roots = [], []
    for tree in sorted(trees, key=str.encode):
        own = sorted(trees[tree], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subroot, paths = climb([leaf_of(r) for r in own])
        roots.append(subroot)
        done.append((own, paths))
    root, above = climb(roots)
    out = []
    for (own, paths), subroot, upper in zip(done, roots, above):
        for r, path in zip(own, paths):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf_of((*r[:2], r[2].replace("A", "a") if bad and r[2] else r[2]))
            for place, others in path + upper:
                node = sha("".join([*others[:place], node, *others[place:]]))
            out.append((r[0], leaf_of(r), subroot, root, sha("".join(s for _, others in path + upper for s in others)), node))
    return sorted(out, key=repr)


def run(spark, rows, levels):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, lang string, text string, hash string, at int, tree string")
    found, root = merkle.manifest(df, "doc_id", "lang", ["doc_id", "lang", "text"], {"text": F.translate("text", "A", "a")}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, levels)
    return found, root


@pytest.mark.parametrize("levels", [1, 2, 3, 4])
def test_equals_the_whole_tree(spark, levels):
    rows = [(k, "en", f"A text {k}") for k in range(600)] + [(k, None, "A") for k in range(600, 609)] + [(k, "dé", "a\n") for k in range(700, 764)]
    rows += [(900, "one", "AAA"), (3, "en", "A text 3"), (3, "en", "other A"), (None, "en", "A no id"), (None, None, None), (901, "", ""), (902, "z", "long A " * 20_000)]
    rows += [(1000 + k, f"lang{k:03d}", "A") for k in range(90)]
    found, root = run(spark, rows, levels)
    out = found.collect()
    assert sorted([(r.id, r.hash, r.subroot, root, r.proof_sha256, r.folded_root) for r in out], key=repr) == brute(rows)
    for r in out:
        path = merkle.read_back(r.path)
        assert merkle.written_out(path) == r.path and merkle.folded(r.hash, path) == root


def test_small_and_empty_tables(spark):
    for rows in ([(1, "en", "A")], [(1, None, None)], [(1, "en", "A"), (1, "en", "A")]):
        found, root = run(spark, rows, 4)
        assert sorted([(r.id, r.hash, r.subroot, root, r.proof_sha256, r.folded_root) for r in found.collect()], key=repr) == brute(rows)
    found, root = run(spark, [], 4)
    assert found.collect() == [] and root is None


def test_subtrees_are_few(spark):
    """Of a block of 4096 leaves a layer holds two subtrees, and the desired one is whole when it's entered."""
    leaves = [sha(str(k)) for k in range(4000)]
    layer = merkle.Layer(leaves, 0, 2)
    for at in range(len(leaves)):
        layer.passed(at)
        assert len(layer.existing[0]) + len(layer.desired) <= 128 and (at + 1) % 64 or layer.desired == []
    assert [p for p in merkle.traversed(leaves, 4)] == climb(leaves)[1]


def test_query(spark, sf_dir):
    assert_same(QUERIES["op12_merkle_manifest"](spark, sf_dir), connect(sf_dir), SQL["op12_merkle_manifest"])
