"""A Merkle manifest of a table: a hash tree for each key, and one over the trees' roots.

Rows are ranked within their tree by one range sort. Leaves are cut into aligned blocks of ARITY ** LEVELS; a
block's root is a node of the next tier, which is cut in the same way, until a tree is one node: its subroot. The
subroots form one more tree, whose root is the table's. Tiers shrink by the block's size, so there are few.

Proofs come down again. A block gets the proof of its root, from the tier above, and is traversed fractally: of
each layer of subtrees (HEIGHT levels each) it keeps the existing one, which holds the siblings on the current path,
and the desired one, its successor, which grows by a node whenever as many leaves have been passed as the node has
below it, so that it is whole when the path enters it. A leaf's path is read off the existing subtrees and the
block's own proof is appended. Memory is a block's leaves and two subtrees a layer. Only hashes, ids and keys are
shuffled, never texts or finished proofs.

A hash is the lowercase hex sha256 of its inputs, concatenated; node hashes go in as hex text.

Defined results: nulls in any column are as the leaf's format has them; a null key has a tree of its own, before all
others; ids ascend, null first, rows of one id by their leaves, so that repeated rows have equal leaves at
neighbouring places; a tree of one leaf has that leaf as its root and no siblings; texts of any length are whole; an
empty table gives an empty table. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomframe.llm.common import by_group, written

#: Children of a node, levels of a block, levels of a traversed subtree.
ARITY, LEVELS, HEIGHT = 8, 4, 2
#: Digits of a hash.
DIGITS = 64


def hashed(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(columns: Sequence[Column]) -> Column:
    """The hash of each value as `-` if null, else its UTF-8 byte count, a colon and itself."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def levels_of(n: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def parents(nodes: list[str]) -> list[str]:
    return [hashed(nodes[k : k + ARITY]) for k in range(0, len(nodes), ARITY)]


def top(nodes: list[str], levels: int) -> str:
    """The one node that is so many levels above the nodes."""
    for _ in range(levels):
        nodes = parents(nodes)
    return nodes[0]


class Layer:
    """The subtrees of one layer of a block: the existing one and the desired one after it."""

    def __init__(self, leaves: list[str], base: int, height: int) -> None:
        self.leaves, self.base, self.height = leaves, base, height
        #: Leaves below a base node, and below a subtree.
        self.wide, self.span = ARITY**base, ARITY ** (base + height)
        self.desired: list[str] = []
        for k in range(ARITY**height):
            self.grow(k * self.wide)
        self.enter()

    def grow(self, start: int) -> None:
        """The base node over the leaves from `start`, if there is one, becomes part of the desired subtree."""
        if start < len(self.leaves):
            self.desired.append(top(self.leaves[start : start + self.wide], self.base))

    def enter(self) -> None:
        self.existing = [self.desired]
        for _ in range(1, self.height):
            self.existing.append(parents(self.existing[-1]))
        self.desired = []

    def passed(self, at: int) -> None:
        """The path of leaf `at` has been read."""
        if at % self.wide == 0:
            self.grow(at + self.span)
        if (at + 1) % self.span == 0 and at + 1 < len(self.leaves):
            self.enter()

    def siblings(self, at: int) -> Iterator[tuple[int, list[str]]]:
        """By level the place of the path's node in its run and the run's others."""
        place = at % self.span // self.wide
        for nodes in self.existing:
            begin = place - place % ARITY
            run = nodes[begin : begin + ARITY]
            yield place - begin, run[: place - begin] + run[place - begin + 1 :]
            place //= ARITY


def traversed(leaves: list[str], levels: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The authentication paths of successive leaves, up to the node that is so many levels above."""
    layers = [Layer(leaves, base, min(HEIGHT, levels - base)) for base in range(0, levels, HEIGHT)]
    for at in range(len(leaves)):
        yield [step for layer in layers for step in layer.siblings(at)]
        for layer in layers:
            layer.passed(at)


def written_out(path: list[tuple[int, list[str]]]) -> str:
    """A path as text: by level a slash, the place in the run, a colon and the siblings."""
    return "".join(f"/{place}:{''.join(others)}" for place, others in path)


def read_back(path: str) -> list[tuple[int, list[str]]]:
    steps = [step.partition(":") for step in path.split("/")[1:]]
    return [(int(place), [others[k : k + DIGITS] for k in range(0, len(others), DIGITS)]) for place, _, others in steps]


def folded(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a node and its path lead to."""
    for place, others in path:
        node = hashed([*others[:place], node, *others[place:]])
    return node


def placed(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """nodes with `at`, the rank in their `tree`, and `n`, the tree's number of nodes: one range sort, then counts of
    what earlier partitions hold, a row for each tree and partition."""
    rows = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    # the low 33 bits are the row's number within its partition
    rows = rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    rows = written(rows, "ranked")
    counts = rows.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    tree = Window.partitionBy("tree")
    counts = counts.select("tree", "_part", "_first", (F.sum("_n").over(tree.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(tree).alias("n"))
    return rows.join(counts, ["tree", "_part"]).withColumn("at", F.col("_row") - F.col("_first") + F.col("_before")).drop("_part", "_row", "_first", "_before")


def block_of(levels: int) -> Column:
    return F.floor(F.col("at") / ARITY**levels).alias("block")


def by_block(rows: DataFrame) -> DataFrame:
    """The rows of a block in one partition, together and in order."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")


def block_roots(nodes: DataFrame, levels: int) -> DataFrame:
    """The nodes (tree, at, n, hash) of the next tier."""
    schema = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("hash", pa.string())])

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        n = group["n"][0].as_py()
        root = top(group["hash"].to_pylist(), min(levels, levels_of(n)))
        yield pa.record_batch([[group["tree"][0].as_py()], [group["block"][0].as_py()], [-(-n // ARITY**levels)], [root]], schema=schema)

    rows = nodes.select("tree", block_of(levels), "at", "n", "hash")
    return by_block(rows).mapInArrow(by_group(["tree", "block"], schema, work), "tree string, at long, n long, hash string")


def tiers_of(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes, their blocks' roots, and so on up to the trees' roots."""
    tiers, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        tiers.append(written(block_roots(tiers[-1], levels), "block-roots"))
        most = -(-most // ARITY**levels)
    return tiers


def proven(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """nodes (tree, at, n, hash, id, tampered) as (id, tree, at, hash, subroot, path, proof_sha256, folded_root); above
    holds each block's (tree, at, subroot, path). folded_root is of the tampered hash where there is one."""
    given = nodes.schema["id"]
    schema = StructType([given, *[StructField(c, StringType()) for c in ("tree", "hash", "subroot", "path", "proof_sha256", "folded_root")]]).add("at", "long")
    names = schema.names

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        # the block's own proof comes first
        subroot, upper = group["subroot"][0].as_py(), read_back(group["path"][0].as_py())
        group = group.slice(1)
        leaves, tampered = group["hash"].to_pylist(), group["tampered"].to_pylist()
        paths, proofs, roots = [], [], []
        for k, own in enumerate(traversed(leaves, min(levels, levels_of(group["n"][0].as_py())))):
            path = own + upper
            paths.append(written_out(path))
            proofs.append(hashed([s for _, others in path for s in others]))
            roots.append(folded(tampered[k] or leaves[k], path))
        made = {"id": group["id"], "tree": group["tree"], "hash": group["hash"], "at": group["at"], "subroot": pa.array([subroot] * len(leaves)), "path": pa.array(paths), "proof_sha256": pa.array(proofs), "folded_root": pa.array(roots)}
        yield from pa.table([made[c] for c in names], names=names).to_batches(1000)

    rows = nodes.select("tree", block_of(levels), "at", "n", "hash", "id", "tampered")
    headers = above.select("tree", F.col("at").alias("block"), F.lit(-1).cast("long").alias("at"), "subroot", "path")
    both = by_block(rows.unionByName(headers, allowMissingColumns=True))
    return both.mapInArrow(by_group(["tree", "block"], None, work), schema)


def all_proofs(tiers: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The first tier's nodes as `proven` has them; above holds the trees' own proofs."""
    for tier in tiers[-2:0:-1]:
        nodes = tier.withColumns({"id": F.lit(None).cast("string"), "tampered": F.lit(None).cast("string")})
        above = written(proven(nodes, above, levels).select("tree", "at", "subroot", "path"), "block-proofs")
    return proven(tiers[0], above, levels)


def manifest(
    rows: DataFrame, row_id: str, key: str, columns: Sequence[str], tampered: dict[str, Column] | None = None, where: Column | None = None, levels: int = LEVELS
) -> tuple[DataFrame, str | None]:
    """((id, hash, subroot, path, proof_sha256, folded_root, ...) of each row, the table's root).

    A row's leaf is of `columns`; a tree holds the rows of one `key`. proof_sha256 is the hash of a path's siblings.
    folded_root is where the leaf leads by its path: the root, unless the leaf is recomputed with `tampered` columns, as
    it is `where` that holds, and these are unlike.
    """
    col = lambda c: F.col(f"`{c}`")
    changed = leaf([(tampered or {}).get(c, col(c)) for c in columns])
    nodes = rows.select(
        # trees in the order of their keys, null first
        F.coalesce(F.concat(F.lit(":"), col(key).cast("string")), F.lit("")).alias("tree"), col(row_id).alias("id"),
        leaf([col(c) for c in columns]).alias("hash"), F.when(F.lit(False) if where is None else where, changed).alias("tampered"),
    )
    tiers = tiers_of(placed(nodes, ["id", "hash"]), levels)
    # One more tree: its leaves are the trees' roots, which are the last tier.
    roots = tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("id"), "hash", F.lit(None).cast("string").alias("tampered"))
    upper = tiers_of(placed(roots, ["id"]), levels)
    last = upper[-1].select("tree", "at", F.col("hash").alias("subroot"), F.lit("").alias("path"))
    trees = all_proofs(upper, last, levels).select(F.col("id").alias("tree"), F.lit(0).cast("long").alias("at"), F.col("hash").alias("subroot"), "path")
    root = last.first()
    return all_proofs(tiers, written(trees, "tree-proofs"), levels), root and root.subroot
