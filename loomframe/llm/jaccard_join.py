"""Exact n-gram Jaccard join of documents by forests of signature trees.

1. A first pass counts prefix shingles; those in many documents mark bits of a map whose size follows
   their number. The map only orders shingles (marked ones last), so its false marks cost nothing in
   exactness.
2. A second pass gives each document its set's size and fingerprint, the first
   n - ceil(t n) + 1 shingles in that order (similar sets share one of these), and a bitmap of all.
   Equal sets become one class, so copies are never paired.
3. Each shared prefix shingle roots one tree; roots with equal members are one. Trees hold OR-combined
   bitmaps and size ranges; dual traversal drops node pairs whose largest possible overlap is too small.
   What is left is verified on whole shingle sets. Only the tree of the first shingle that two sets
   share in the order must find them: there, a set's later shingles alone count (`reach`).
4. A tree that is too large for one task isn't paired at first: all its members are compared with one
   pivot, the member with the fewest unmarked shingles, which stands nearest to what the others share.
   After that, members outside the tree's largest component are compared with all members; trees within
   one component are done. They meet by bitmaps in four parts of a tree, each sent once for each of the other side's,
   so rows follow the members; only what bitmaps leave is dealt into parts whose whole sets fit a task.
5. Verification emits only links that join two sets of documents (a spanning forest), never all pairs
   of a group. In the first round each document takes part in its largest tree only, in the second each
   in its largest of those that a finer bitmap leaves; the third one takes all that is left, without the
   pairs that are in one component by then or were compared in a tree that both picked in the first
   round. No other pair is skipped.

Defined results: null, empty or blank texts have no shingles and link with nothing; texts of fewer
words than a shingle are one shingle; rows with equal doc_id are one document, which has the links of
all its texts and one component, unless `by_text` makes unlike texts of a doc_id documents of their own;
a null doc_id links with nothing and has a null component; repeated rows are all returned; texts of any
length are whole; an empty table gives an empty table; other columns of the input are ignored. Shingles are compared as 64-bit hashes, sets as 128-bit fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import by_group, dropped, mixed, sliced, split_words, tidy, written
from loomframe.llm.components import components, owners, with_least

WIDTH, PERCENT = 5, 80
#: A shingle in more prefixes than this is ordered last.
HOT = 32
#: Bits of a map: the power of two at or above 8 for each value, within these (128 KB and 16 MB).
LEAST_MAP, MOST_MAP = 1 << 20, 1 << 27
#: Documents that a task compares with a pivot; shingles that it holds; a tree's fan-out.
CHUNK, CHUNK_SHINGLES, FANOUT = 256, 1 << 21, 8
#: Where all of a tree is wanted by what a pivot left, a task takes a quarter, but CHUNK to MOST_CHUNK documents, and
#: no more shingles than these, as it holds their bitmaps only: 16 MB a side.
MOST_CHUNK, SKETCHED_SHINGLES = 1 << 13, 1 << 26
#: Parts that one side of a group is dealt into again at most, before whole sets are sent.
AGAIN = 1 << 12
#: Bits of a signature: the power of two at or above the set's size, within these; the finer one has FINE times the bits.
LEAST_BITS, MOST_BITS, FINE = 64, 1 << 17, 8


# Sets ---------------------------------------------------------------------------------------------


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    import pyarrow.compute as pc

    offsets, words = split_words(pc.ascii_lower(texts))
    coded = words.dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashes = known[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.uint64)
    rolled = np.zeros(0, np.uint64)
    if len(hashes) >= width:
        m = len(hashes) - width + 1
        rolled = mixed(hashes[:m])
        for k in range(1, width):
            rolled = mixed(rolled + hashes[k : m + k] * np.uint64(2 * k + 1))
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if hi - lo >= width:
            yield np.unique(rolled[lo : hi - width + 1])
        elif hi > lo:
            yield np.array([xxhash.xxh64_intdigest(hashes[lo:hi].tobytes(), seed=hi - lo)], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def bit_width(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, n - 1).bit_length()))


def signature(found: np.ndarray, times: int = 1) -> bytes:
    width = bit_width(len(found) * times)
    bits = np.zeros(width, np.uint8)
    bits[((found >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def map_bits(n: int) -> int:
    return min(MOST_MAP, max(LEAST_MAP, 1 << (8 * n).bit_length()))


def marks(values: DataFrame, bits: int) -> np.ndarray:
    """A map of `bits` bits with those of the values' low bits set; at most bits / 64 rows reach the driver."""
    slot = F.col(values.columns[0]).bitwiseAND(F.lit(bits - 1))
    rows = values.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast({values.columns[0]} & 63L as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    with tidy(values.sparkSession):
        found = rows.toArrow()
    out[np.asarray(found["at"])] = np.asarray(found["bits"])
    return out.view(np.uint8)


def frequent(counts: DataFrame, least: int) -> np.ndarray:
    """The map of the first column's values whose count c is above `least`, or above the least doubling of
    it that leaves an eighth of the largest map's bits to them."""
    table = written(counts.where(F.col("c") > least), "often")
    step = F.floor(F.log2((F.col("c") - 1) / F.lit(least)))
    sizes = {r["step"]: r["n"] for r in table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()}
    times = 0
    while (n := sum(v for k, v in sizes.items() if k >= times)) > MOST_MAP // 8:
        times += 1
    out = marks(table.where(F.col("c") > least << times).select(counts.columns[0]), map_bits(n))
    dropped(table)
    return out


def marked(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = (values & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def prefix_tokens(docs: DataFrame, width: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = [s[: prefix_length(len(s), percent)] for s in shingle_sets(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["token"])

    return docs.select("text").mapInArrow(run, "token long")


def signed(docs: DataFrame, hot: np.ndarray, width: int, percent: int) -> DataFrame:
    """(doc_id, mark, n, rare, fp, prefix, bits) of every row; mark is its text's hash, rare counts the set's unmarked shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in sliced(batches, "text"):
            n, rare, fp, prefix, bits = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), width):
                late = marked(bitmap, s)
                n.append(len(s))
                rare.append(len(s) - int(np.count_nonzero(late)))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                prefix.append(np.concatenate([s[~late], s[late]])[: prefix_length(len(s), percent)].view(np.int64))
                bits.append(signature(s))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefix])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefix)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(rare, pa.int64()), pa.array(fp, pa.binary()), lists, pa.array(bits, pa.binary())], ["doc_id", "mark", "n", "rare", "fp", "prefix", "bits"])

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, n long, rare long, fp binary, prefix array<long>, bits binary")


def sets_of(docs: DataFrame, needed: np.ndarray, width: int) -> DataFrame:
    """(doc_id, fp, n, fine, shingles) of the rows whose doc_id's bit is marked; fine is the finer bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(needed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = whole.filter(pa.array(marked(shared.value, np.asarray(whole.column("doc_id")).astype(np.int64).view(np.uint64))))
            for part in sliced(iter([batch]), "text"):
                found = list(shingle_sets(part.column("text"), width))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), pa.array([len(s) for s in found], pa.int64()), pa.array([signature(s, FINE) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["doc_id", "fp", "n", "fine", "shingles"])

    return docs.where("doc_id is not null").mapInArrow(run, "doc_id long, fp binary, n long, fine binary, shingles binary")


# Trees --------------------------------------------------------------------------------------------


def needed_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of sets of sizes a and b at the threshold."""
    return -((-percent * (a + b)) // (100 + percent))


class SignatureTree:
    """Levels from single documents up; a node ORs its children's bitmaps and spans their sizes.

    reach: how many shingles of a document count at most, its size if all do.
    """

    def __init__(self, sizes: np.ndarray, reach: np.ndarray, bits: list[bytes], width: int) -> None:
        self.order = np.lexsort((np.arange(len(sizes)), sizes))
        rows = [np.bitwise_or.reduce(np.frombuffer(bits[k], np.uint8).reshape(-1, width), axis=0) for k in self.order]
        base = np.stack(rows).view(np.uint64)
        n = sizes[self.order].astype(np.int64)
        self.levels = [(base, n, n, n - np.bitwise_count(base).sum(axis=1).astype(np.int64), reach[self.order].astype(np.int64))]
        while len(self.levels[-1][1]) > 1:
            base, low, high, spare, most = self.levels[-1]
            cuts = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(base, cuts, axis=0), np.minimum.reduceat(low, cuts), *(np.maximum.reduceat(x, cuts) for x in (high, spare, most))))

    def at(self, level: int) -> tuple[np.ndarray, ...]:
        """A level; above the root there is the root again."""
        return self.levels[min(level, len(self.levels) - 1)]


def possible(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs may hold a similar pair: sizes that fit, and enough overlap at best."""
    base, low, high, spare, most = left
    base2, low2, high2, spare2, most2 = right
    ok = (100 * high[p] >= percent * low2[q]) & (100 * high2[q] >= percent * low[p])
    ok &= np.minimum(most[p], most2[q]) >= needed_overlap(low[p], low2[q], percent)
    at = np.flatnonzero(ok)
    step = max(1, (16 << 20) // (base.shape[1] * 8))
    for k in range(0, len(at), step):
        i = at[k : k + step]
        both = np.bitwise_count(base[p[i]] & base2[q[i]]).sum(axis=1).astype(np.int64)
        ok[i] = both + np.minimum(spare[p[i]], spare2[q[i]]) >= needed_overlap(low[p[i]], low2[q[i]], percent)
    return ok


def traversed(left: SignatureTree, right: SignatureTree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Document pairs that a dual traversal leaves, as places of each tree's input; each pair once if the trees are one."""
    same, top = left is right, max(len(left.levels), len(right.levels)) - 1
    p = q = np.zeros(0 if same and not top else 1, np.int64)
    if not top and not same:
        keep = possible(left.at(0), right.at(0), p, q, percent)
        p, q = p[keep], q[keep]
    for level in range(top - 1, -1, -1):
        one, two = left.at(level), right.at(level)
        got = []
        for k in range(0, len(p), 1 << 12):
            a = np.repeat(p[k : k + (1 << 12), None] * FANOUT + np.arange(FANOUT), FANOUT, axis=1).ravel()
            b = np.tile(q[k : k + (1 << 12), None] * FANOUT + np.arange(FANOUT), (1, FANOUT)).ravel()
            fit = (a < len(one[1])) & (b < len(two[1]))
            if same:
                fit &= (a < b) if level == 0 else (a <= b)
            a, b = a[fit], b[fit]
            keep = possible(one, two, a, b, percent)
            got.append((a[keep], b[keep]))
        p, q = (np.concatenate([g[k] for g in got]) for k in (0, 1)) if got else (np.zeros(0, np.int64),) * 2
    return left.order[p], right.order[q]


#: What a row is to its group: compared with those of the other side, or, BOTH, with every other one.
LEFT, RIGHT, BOTH = 1, 2, 3


def candidates(sizes: np.ndarray, reach: np.ndarray, bits: list[bytes], role: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group that may be similar. Bitmaps are as wide as the shortest set's, so sizes are
    first split into ranges; a similar pair is in one range or in two that adjoin."""
    bucket = np.zeros(len(sizes), np.int64)
    if sizes.max() * percent > 100 * sizes.min():
        # A little more than the factor between similar sets keeps rounding out.
        bucket = np.floor(np.log(sizes) / math.log(100 / percent * 1.0001)).astype(np.int64)
    trees: dict[tuple[int, int, int], SignatureTree] = {}

    def tree(side: int, k: int, width: int) -> SignatureTree:
        if (side, k, width) not in trees:
            at = places[side, k]
            trees[side, k, width] = SignatureTree(sizes[at], reach[at], [bits[x] for x in at.tolist()], width)
        return trees[side, k, width]

    whole = bool((role == BOTH).all())
    places = {(s, k): at for s in ((BOTH,) if whole else (LEFT, RIGHT)) for k in np.unique(bucket).tolist() if len(at := np.flatnonzero((bucket == k) & (role == s)))}
    found = []
    for side, k in places:
        if side == RIGHT:
            continue
        for other in (k, k + 1) if whole else (k - 1, k, k + 1):
            pair = (BOTH if whole else RIGHT, other)
            if pair in places:
                width = min(len(bits[x]) for at in ((side, k), pair) for x in places[at].tolist())
                i, j = traversed(tree(side, k, width), tree(*pair, width), percent)
                found.append((places[side, k][i], places[pair][j]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def allowed(group: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs of different components that weren't compared in the first round, as two that picked one whole tree were."""
    comp, token = np.asarray(group["comp"]), np.asarray(group["pick"].fill_null(0))
    there = np.asarray(group["pick"].is_valid())
    return (comp[i] != comp[j]) & ((token[i] != token[j]) | ~there[i] | ~there[j])


KEYS = ["token", "lo", "hi"]
MEMBER = "token long, lo int, hi int, node long, role int, size long, whole boolean, reach long, comp long, pick long"
NAMES = [field.split()[0] for field in MEMBER.split(", ")]


def dealt_again(group: pa.Table, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A group's members, of sets of n shingles, in groups whose whole sets fit a task: each side in parts, each of which is
    repeated for each part of the other side. Whole trees do as they are."""
    lo, hi, role = (np.asarray(group[c]) for c in ("lo", "hi", "role"))
    right = role == RIGHT
    a, b = 1, 1
    if not group["whole"][0].as_py():
        a, b = (max(1, min(AGAIN, -(-int(n[side].sum()) // CHUNK_SHINGLES), int(side.sum()))) for side in (~right, right))
    own = np.zeros(len(n), np.int64)
    own[~right], own[right] = np.arange((~right).sum()) % a, np.arange(right.sum()) % b
    times = np.where(right, a, b)
    at = np.repeat(np.arange(len(n)), times)
    other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    rows = group.take(pa.array(at))
    places = {"lo": lo[at] * AGAIN + np.where(right[at], other, own[at]), "hi": hi[at] * AGAIN + np.where(right[at], own[at], other)}
    for c, place in places.items():
        rows = rows.set_column(rows.schema.get_field_index(c), c, pa.array(place.astype(np.int32)))
    yield from rows.combine_chunks().to_batches()


def prune(percent: int, deal: bool = False):
    """For by_group: the members that have a possible partner in another component, in parts for whole sets if `deal`."""

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        n = np.asarray(group["n"])
        i, j = candidates(n, np.asarray(group["reach"]), group["bits"].to_pylist(), np.asarray(group["role"]), percent)
        fit = allowed(group, i, j)
        use = np.unique(np.concatenate([i[fit], j[fit]]))
        if len(use):
            left = group.select(NAMES).take(pa.array(use)).combine_chunks()
            yield from dealt_again(left, n[use]) if deal else left.to_batches()

    return by_group(KEYS, None, work)


def verify(percent: int, first: bool):
    """For by_group: links of whole sets that join components, a spanning forest of the group's links.

    In the first round no pair of a tree counts as another tree's: those who pick it are all compared.
    """

    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        node, comp = np.asarray(group["node"]), np.asarray(group["comp"]).copy()
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
        n = np.array([len(s) for s in sets], np.int64)
        i, j = candidates(n, n if first else np.asarray(group["reach"]), [signature(s, FINE) for s in sets], np.asarray(group["role"]), percent)
        fit = allowed(group, i, j)
        i, j = i[fit], j[fit]
        if not len(i):
            return
        names, ids = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(n)
        own = [ids[e - k : e] for e, k in zip(ends.tolist(), n.tolist())]
        mark = np.zeros(len(names), bool)
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        a, b = [], []
        firsts, starts = np.unique(i, return_index=True)
        for x, lo, hi in zip(firsts.tolist(), starts.tolist(), [*starts[1:].tolist(), len(i)]):
            mark[own[x]] = True
            rest = j[lo:hi]
            while len(rest := rest[comp[rest] != comp[x]]):
                some, rest = rest[:64], rest[64:]
                cuts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                common = np.add.reduceat(mark[np.concatenate([own[y] for y in some])].astype(np.int64), cuts)
                for y in some[100 * common >= percent * (n[x] + n[some] - common)].tolist():
                    if comp[y] != comp[x]:
                        a.append(node[x])
                        b.append(node[y])
                        comp[comp == max(comp[x], comp[y])] = min(comp[x], comp[y])
            mark[own[x]] = False
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return by_group(KEYS, None, work)


def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by token, those whose token has two rows or more; holds one row between batches."""
    held: pa.RecordBatch | None = None
    last, sent = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        token = np.asarray(batch.column("token"))
        same = token[1:] == token[:-1]
        keep = np.zeros(len(token), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if last is not None and token[0] == last:
            keep[0] = True
            if not sent:
                yield held
        if keep.any():
            yield batch.filter(pa.array(keep))
        held, last, sent = batch.slice(batch.num_rows - 1), token[-1], bool(keep[-1])


def grouped(df: DataFrame, work, schema: str) -> DataFrame:
    return df.repartition(*[F.col(k) for k in KEYS]).sortWithinPartitions(*KEYS).mapInArrow(work, schema)


ENTRY = "token long, at int, node long, n long, rare long, weight long, hot boolean"


def parts_of(size: Column, shingles: Column, chunk: Column, most: int = CHUNK_SHINGLES) -> Column:
    """Into how many parts documents are dealt."""
    return F.least(size, F.greatest(F.ceil(size / chunk), F.ceil(shingles / most))).cast("int")


def tree_members(classes: DataFrame, percent: int) -> DataFrame:
    """(token, size, parts, node, n, rare, weight, reach): who stands in which tree; trees of several parts are too large for a task."""
    entries = classes.select(F.posexplode("prefix").alias("at", "token"), "node", "n", "rare", "weight")
    entries = entries.select("token", "at", "node", "n", "rare", "weight", (F.col("at") >= F.col("rare")).alias("hot"))
    # Marked shingles are shared as a rule and may be hot keys: they needn't meet to be found shared.
    alone = entries.where("not hot").repartition("token").sortWithinPartitions("token").mapInArrow(shared_only, ENTRY)
    entries = written(alone.union(entries.where("hot")), "entries")
    tags = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(name) for seed, name in ((1, "x"), (2, "y"))]
    roots = entries.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.min("n").alias("low"), F.bool_and("hot").alias("hot"), *tags).where("size > 1")
    # Of trees with equal members, the one of the first shingle in the order (unmarked ones first, then as unsigned numbers).
    order = F.struct("hot", F.col("token").bitwiseXOR(F.lit(-(1 << 63))).alias("u"), "token")
    roots = roots.groupBy("size", "shingles", "low", "x", "y").agg(F.min(order).alias("first"))
    parts = F.when(F.col("size") > 2, parts_of(F.col("size"), F.col("shingles"), F.lit(CHUNK))).otherwise(1)
    roots = written(roots.select("first.token", "size", "low", parts.alias("parts")), "roots")
    reach = F.col("n") - F.col("at")
    # No member is smaller than low or, if it is similar to another, than its share of that one.
    least = F.greatest(F.col("low"), F.ceil(F.col("n") * percent / 100))
    rows = entries.join(roots, "token").where(reach * (100 + percent) >= percent * (F.col("n") + least))
    out = written(rows.select("token", "size", "parts", "node", "n", "rare", "weight", reach.alias("reach")), "members")
    dropped(entries, roots)
    return out


def part_of(parts: Column) -> Column:
    return F.pmod(F.xxhash64("node"), parts).cast("int")


def first_rows(members: DataFrame) -> DataFrame:
    """Groups of the first round: whole trees, and each part of a large one with the tree's pivot."""
    none = F.lit(None).cast("long").alias("pick")
    large = members.where("parts > 1")
    # The fewest unmarked shingles; then the most copies, the largest set and the smallest id.
    rank = F.struct("rare", (-F.col("weight")).alias("weight"), (-F.col("n")).alias("n"), "node", "reach")
    pivots = large.groupBy("token", "size", "parts").agg(F.min(rank).alias("p"))
    pivots = pivots.select("token", F.lit(0).alias("lo"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("hi"), F.col("p.node").alias("node"), F.lit(LEFT).alias("role"), "size", F.lit(False).alias("whole"), F.col("p.reach").alias("reach"), F.col("p.node").alias("comp"), none)
    one = F.col("parts") == 1
    rows = members.select("token", F.lit(0).alias("lo"), F.when(one, 0).otherwise(part_of(F.col("parts"))).alias("hi"), "node", F.when(one, BOTH).otherwise(RIGHT).alias("role"), "size", one.alias("whole"), "reach", F.col("node").alias("comp"), none)
    return rows.union(pivots)


def last_rows(members: DataFrame, left: DataFrame, picked: DataFrame, found: DataFrame) -> DataFrame:
    """Groups of the second round: what whole trees left, and what is outside a large tree's main component with all of the tree."""
    comp = F.coalesce("component", "node").alias("comp")
    whole = left.where("whole").drop("comp", "pick").join(found, "node", "left").join(picked.withColumnRenamed("token", "pick"), "node", "left")
    whole = whole.select(*NAMES[:-2], comp, "pick")
    several = whole.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("token")
    whole = whole.join(several, "token", "left_semi")
    large = members.where("parts > 1").join(found, "node", "left").select("token", "size", "node", "n", "reach", comp)
    large = written(large, "large")
    main = large.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("shingles"))
    main = main.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("main"), F.sum("c").alias("c"), F.sum("shingles").alias("shingles")).where("c > main.c")
    outer = F.col("c") - F.col("main.c")
    # Parts of either side are sent once for each of the other's, so that there may be few: four of a tree, whose bitmaps
    # fit a task each up to 4 * SKETCHED_SHINGLES and 4 * MOST_CHUNK members, so rows follow the members.
    chunk = F.greatest(F.lit(CHUNK), F.least(F.lit(MOST_CHUNK), F.ceil(F.col("c") / 4)))
    rest = parts_of(outer, F.ceil(F.col("shingles") * outer / F.col("c")), chunk, SKETCHED_SHINGLES)
    main = main.select("token", F.col("main.comp").alias("main"), rest.alias("rest"), parts_of(F.col("c"), F.col("shingles"), chunk, SKETCHED_SHINGLES).alias("deal"))
    rows = large.join(main, "token")
    lo, hi = part_of(F.col("rest")), part_of(F.col("deal"))
    tail = [F.lit(False).alias("whole"), "reach", "comp", F.lit(None).cast("long").alias("pick")]
    all_ = rows.select("token", F.explode(F.sequence(F.lit(0), F.col("rest") - 1)).alias("lo"), hi.alias("hi"), "node", F.lit(RIGHT).alias("role"), "size", *tail)
    outside = rows.where("comp != main").select("token", lo.alias("lo"), F.explode(F.sequence(F.lit(0), F.col("deal") - 1)).alias("hi"), "node", F.lit(LEFT).alias("role"), "size", *tail)
    return whole.union(all_).union(outside)


def with_components(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of groups with their components of now; groups within one are done."""
    rows = rows.drop("comp").join(found, "node", "left").withColumn("comp", F.coalesce("component", "node")).select(*NAMES)
    several = rows.groupBy(*KEYS).agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select(*KEYS)
    return rows.join(several, KEYS, "left_semi")


def picked_rows(rows: DataFrame) -> DataFrame:
    """Of each document that looks for partners, the rows of its largest tree, and the partners in those groups."""
    seeks = rows.where(F.col("role") != RIGHT)
    picked = seeks.groupBy("node").agg(F.max(F.struct("size", "token")).alias("p")).select("node", "p.token")
    seeks = seeks.join(picked, ["node", "token"]).select(*NAMES)
    return seeks.union(rows.where(F.col("role") == RIGHT).join(seeks.select(*KEYS).distinct(), KEYS, "left_semi").select(*NAMES))


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, hot: int = HOT, by_text: bool = False) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id, leads): a row per row of docs.

    mark is xxhash64 of the text. leads: the row is the one that stands for its component, the first by
    doc_id and mark, or equal to it; never without words or doc_id.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    counts = prefix_tokens(docs, width, percent).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    table = written(signed(docs, frequent(counts, hot), width, percent), "signed")
    usable = table.where("n > 0 and doc_id is not null")
    classes = usable.groupBy("fp").agg(F.min(F.struct("doc_id", "mark")).alias("lead"), F.count(F.lit(1)).alias("weight"), F.first(F.struct("n", "rare", "prefix", "bits")).alias("s"))
    # The numbers are fixed as they are written.
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "fp", "lead", "weight", "s.*"), "classes")
    rows = written(table.select("doc_id", "mark", F.col("n").alias("n_shingles"), "fp"), "rows")
    dropped(table)
    members = tree_members(classes, percent)
    sketch = classes.select("node", "n", "bits")

    def pruned(rows: DataFrame, sketch: DataFrame, deal: bool = False) -> DataFrame:
        return written(grouped(rows.join(sketch, "node"), prune(percent, deal), MEMBER), "pruned")

    left = pruned(first_rows(members), sketch)
    nodes = left.select("node").union(members.where("parts > 1").select("node")).distinct()
    nodes = written(classes.select("node", "fp", F.col("lead.doc_id").alias("doc_id")).join(nodes, "node", "left_semi"), "nodes")
    sets = sets_of(docs, marks(nodes.select("doc_id"), map_bits(nodes.count())), width).dropDuplicates(["doc_id", "fp"])
    sets = written(sets.join(nodes, ["doc_id", "fp"]).select("node", "n", "fine", "shingles"), "sets")
    fine, whole = sets.select("node", "n", F.col("fine").alias("bits")), sets.select("node", "shingles")

    def verified(rows: DataFrame, first: bool) -> DataFrame:
        return written(grouped(rows.join(whole, "node"), verify(percent, first), "a long, b long"), "verified")

    picked = left.where(F.col("role") != LEFT).groupBy("node").agg(F.max(F.struct("size", "token", "whole")).alias("p"))
    picked = written(picked.select("node", "p.token", "p.whole"), "picks")
    once = left.where(F.col("role") != LEFT).join(picked.drop("whole"), ["node", "token"]).select(*NAMES)
    links = verified(once.union(left.where(F.col("role") == LEFT)), True)
    found = components(links)
    some = pruned(last_rows(members, left, picked.where("whole").drop("whole"), found), sketch, deal=True)
    dropped(members, left, links, picked, nodes)
    close = pruned(some, fine)
    dropped(some)
    links = verified(picked_rows(close), False)
    old, found = found, components(links.union(found))
    dropped(links, old)
    last = pruned(with_components(close, found), fine)
    dropped(close)
    links = verified(last, False)
    dropped(last, sets)
    more = links.union(found)
    ids = None
    if not by_text:
        # A doc_id's unlike texts are one document: its classes are linked.
        ids = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x < y")
        ids = written(ids.select("doc_id"), "shared-ids")
        more = more.union(owners(rows.join(ids, "doc_id", "left_semi").join(classes.select("fp", "node"), "fp").select("doc_id", "node"), "doc_id"))
    old, found = found, components(more)
    dropped(links, old)
    label = written(with_least(classes.select("node", "fp", "lead"), found, "lead").select("fp", "first"), "labels")
    dropped(classes, found)
    out = rows.join(label, "fp", "left")
    leads = F.coalesce((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.mark") == F.col("mark")), F.lit(False)).alias("leads")
    component = F.coalesce("first.doc_id", "doc_id")
    if ids is not None:
        # A text without words has its document's component too.
        also = rows.join(ids, "doc_id", "left_semi").join(label, "fp").groupBy("doc_id").agg(F.min("first.doc_id").alias("of_id"))
        out = out.join(written(also, "of-ids"), "doc_id", "left")
        dropped(ids)
        component = F.coalesce("first.doc_id", "of_id", "doc_id")
    return out.select("doc_id", "mark", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), leads)
