"""Chat formatting as prefix trees.

Conversations that begin with the same turns share those turns' tokens: conversations are
range-sorted by the chained digests of their turns, so that equal beginnings are neighbours, and a
sweep emits each new turn once, depth first. A packed row holds whole trees up to `most_tokens`
tokens: token ids, one node for each emitted turn and one entry for each conversation. A node has
its place, the position id of its first token (tokens before it in its conversation), its parent, the
interval under the loss mask and the intervals its tokens attend to: its ancestors' and its own.
Rows are complete in themselves: a shared beginning is emitted again in the next row, never referred
to across rows. The sort key ends in the conversation's id, so copies of one conversation spread
over many tasks.

A turn is START role newline text END newline. In texts and roles `\\`, `<` and `[` become `\\\\`,
`\\l` and `\\i` (and newlines of roles `\\n`), so no control string can occur in them; reading back
reverses this. Header, text and tail are encoded apart, so the loss mask falls on token boundaries.

Defined results: null roles and texts are empty; rows are ordered by turn, role and text, nulls
first, and repeated rows are turns of their own; each row with a null conv_id is a conversation of its
own, as nothing says which belong together; an empty table gives an empty table; other columns are
ignored. One conversation must fit in memory.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
TOKENIZER = "byte_bpe_50k.json"
MOST_TOKENS = 1 << 15
_OUT = str.maketrans({"\\": "\\\\", "<": "\\l", "[": "\\i"})
_BACK = {"\\": "\\", "l": "<", "i": "[", "n": "\n"}


def escaped(text: str, role: bool = False) -> str:
    out = text.translate(_OUT)
    return out.replace("\n", "\\n") if role else out


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.S)


def segments(role: str, text: str) -> tuple[str, str, str]:
    """Header, text and tail of a formatted turn."""
    return f"{START}{escaped(role, True)}\n", escaped(text), f"{END}\n"


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out = []
    for part in formatted.split(START)[1:]:
        role, text = part.removesuffix(f"{END}\n").split("\n", 1)
        out.append((unescaped(role), unescaped(text)))
    return out


@functools.cache
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def encode(path: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


# Fixed value: how the tokenizer's file says that text is split before its merges.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Texts of these characters only, of whose classes all regular expressions are of one mind, are split here.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xc0-\u024f]*")
#: Pieces that a worker remembers, and how many are encoded as one text.
MOST_PIECES, JOINED = 200_000, 256


@functools.cache
def blanks(path: str) -> np.ndarray:
    """By token: whether it begins with a blank."""
    vocabulary = tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[k for token, k in vocabulary.items() if token.startswith("\u0120")]] = True
    return out


class Pieces:
    """Token ids of many texts: no merge crosses a piece's edge, so each distinct piece is encoded once."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.begin, self.size = array("i"), array("q"), array("q")

    def add(self, pieces: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        at = len(self.begin)
        self.known.update(zip(pieces, range(at, at + len(pieces))))
        self.begin.frombytes((np.cumsum(sizes) - sizes + len(self.flat)).astype(np.int64).tobytes())
        self.size.frombytes(sizes.astype(np.int64).tobytes())
        self.flat.frombytes(ids.astype(np.int32).tobytes())

    def learn(self, new: list[str]) -> None:
        """Words that follow a blank make one text, in which a token with the blank's mark begins each."""
        words = [x for x in new if x[0] == " " and x[1:].isalpha()]
        others = [x for x in new if not (x[0] == " " and x[1:].isalpha())]
        groups = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        for group, ids in zip(groups, encode(self.path, ["".join(g) for g in groups])):
            found = np.array(ids, np.int32)
            starts = np.flatnonzero(blanks(self.path)[found])
            if len(starts) == len(group) and starts[0] == 0:
                self.add(group, np.diff(starts, append=len(found)), found)
            else:
                others += group
        each = encode(self.path, others)
        self.add(others, np.array([len(x) for x in each], np.int64), np.array([i for x in each for i in x], np.int32))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > MOST_PIECES:
            self.clear()
        plain = [PLAIN.fullmatch(t) is not None for t in texts]
        lists = [PIECE.findall(t) if p else [] for t, p in zip(texts, plain)]
        every = [x for pieces in lists for x in pieces]
        self.learn([x for x in dict.fromkeys(every) if x not in self.known])
        which = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        size = np.array(self.size, np.int64)[which]
        upto = np.concatenate([[0], np.cumsum(size)])
        flat = np.array(self.flat, np.int32)[np.repeat(np.array(self.begin, np.int64)[which] - upto[:-1], size) + np.arange(upto[-1])]
        ends = upto[np.cumsum([0, *map(len, lists)])].tolist()
        others = iter(encode(self.path, [t for t, p in zip(texts, plain) if not p]))
        return [flat[a:b] if p else np.array(next(others), np.int32) for p, a, b in zip(plain, ends, ends[1:])]


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
NODE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "length", "position", "parent", "loss_start", "loss_end")] + [T.StructField("attends", T.ArrayType(SPAN))])
CONV = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("leaf", T.IntegerType())])
PACKED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("nodes", T.ArrayType(NODE)), T.StructField("convs", T.ArrayType(CONV))])
#: Bytes of texts that a worker takes at a time, and tokens or characters that it hands on at a time.
SLICE, MOST_OUT = 2 << 20, 1 << 21


def offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))


class Packer:
    """Packed rows in the making, column by column: conversations come in sorted order."""

    def __init__(self, path: str) -> None:
        self.path, self.known = path, {}
        self.fixed: dict[str, np.ndarray] = {}
        self.begin()
        self.clear()

    def clear(self) -> None:
        """Forget the finished rows."""
        self.ids: list[np.ndarray] = []
        self.fields: dict[str, list[int]] = {n: [] for n in ("start", "length", "position", "parent", "loss_start", "loss_end", "spans")}
        self.spans: tuple[list[int], list[int]] = ([], [])
        self.convs: tuple[list[int | None], list[int]] = ([], [])
        self.rows: tuple[list[int], list[int], list[int]] = ([], [], [])

    def begin(self) -> None:
        """Start a row."""
        self.tokens = self.nodes = self.held = 0
        # Of each turn above: its digest, node, tokens in the conversation up to its end, and what it attends to.
        self.stack: list[tuple[bytes, int, int, list[tuple[int, int]]]] = []

    def learn(self, texts: list[str]) -> None:
        """Encode the texts of a slice at once, each distinct one once."""
        new = list(dict.fromkeys(texts))
        self.known = dict(zip(new, pieces(self.path).encode([escaped(t) for t in new])))

    def body(self, text: str) -> np.ndarray:
        found = self.known.get(text)
        return pieces(self.path).encode([escaped(text)])[0] if found is None else found

    def around(self, part: str) -> np.ndarray:
        """A header or the tail, of which there are few; forgotten if there aren't."""
        if part not in self.fixed:
            if len(self.fixed) > 1000:
                self.fixed.clear()
            self.fixed[part] = np.array(encode(self.path, [part])[0], np.int32)
        return self.fixed[part]

    def shared(self, digests: list[bytes]) -> int:
        n = 0
        while n < min(len(self.stack), len(digests)) and self.stack[n][0] == digests[n]:
            n += 1
        return n

    def add(self, conv_id: int | None, digests: list[bytes], roles: list[str], texts: list[str]) -> None:
        shared = self.shared(digests)
        del self.stack[shared:]
        for k in range(shared, len(digests)):
            head, _, tail = segments(roles[k], "")
            parts = [self.around(head), self.body(texts[k]), self.around(tail)]
            n, start = sum(map(len, parts)), self.tokens
            parent, position, spans = self.stack[-1][1:] if self.stack else (-1, 0, [])
            loss = start + len(parts[0])
            spans = [*spans[:-1], (spans[-1][0], start + n)] if spans and spans[-1][1] == start else [*spans, (start, start + n)]
            for name, value in zip(self.fields, (start, n, position, parent, loss, loss + len(parts[1]) if roles[k] == TRAINED_ROLE else loss, len(spans))):
                self.fields[name].append(value)
            for a, b in spans:
                self.spans[0].append(a)
                self.spans[1].append(b)
            self.ids += parts
            self.stack.append((digests[k], self.nodes, position + n, spans))
            self.tokens, self.nodes = self.tokens + n, self.nodes + 1
        self.convs[0].append(conv_id)
        self.convs[1].append(self.stack[-1][1])
        self.held += 1

    def end(self) -> None:
        """Finish the row."""
        for column, n in zip(self.rows, (self.tokens, self.nodes, self.held)):
            column.append(n)
        self.begin()

    def batch(self) -> pa.RecordBatch:
        """The finished rows."""
        ints = lambda x: pa.array(x, pa.int32())
        spans = pa.StructArray.from_arrays([ints(x) for x in self.spans], ["start", "end"])
        *plain, counts = self.fields.values()
        nodes = pa.StructArray.from_arrays([*map(ints, plain), pa.ListArray.from_arrays(offsets(counts), spans)], NODE.fieldNames())
        convs = pa.StructArray.from_arrays([pa.array(self.convs[0], pa.int64()), ints(self.convs[1])], CONV.fieldNames())
        flat = pa.array(np.concatenate(self.ids) if self.ids else np.zeros(0, np.int32), pa.int32())
        out = [pa.ListArray.from_arrays(offsets(n), values) for n, values in zip(self.rows, (flat, nodes, convs))]
        self.clear()
        return pa.RecordBatch.from_arrays(out, PACKED.fieldNames())


def conversations(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, path, roles, texts, size): the turns of a conversation in order, their chained digests and bytes."""
    names = ["conv_id", "path", "roles", "texts", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, held, chain, roles, texts, size = None, 0, [], [], [], 0

        def finished() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64()))], names)
            done.clear()
            return out

        for batch in batches:
            for c, alone, r, t in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "alone", "role", "text")]):
                if (c, alone) != key:
                    if chain:
                        done.append((key[0], b"".join(chain), roles, texts, size))
                        held += size
                        if held > SLICE:
                            yield finished()
                            held = 0
                    key, chain, roles, texts, size = (c, alone), [], [], [], 0
                said = t.encode("utf-8", "surrogatepass")
                chain.append(xxhash.xxh3_128_digest(b"\0".join([chain[-1] if chain else b"", r.encode("utf-8", "surrogatepass"), said])))
                roles.append(r)
                texts.append(t)
                size += len(said)
        if chain:
            done.append((key[0], b"".join(chain), roles, texts, size))
        if done:
            yield finished()

    named = {"conv_id": F.col(f"`{conv_id}`").cast("long"), "turn": F.col(f"`{turn}`"), "role": F.col(f"`{role}`"), "text": F.col(f"`{text}`")}
    rows = turns.select(*[c.alias(n) for n, c in named.items()])
    # Rows without a conv_id are dealt out by a number of their own.
    rows = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    rows = rows.repartition("conv_id", "alone").sortWithinPartitions("conv_id", "alone", "turn", "role", "text")
    rows = rows.select("conv_id", "alone", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "conv_id long, path binary, roles array<string>, texts array<string>, size long")


def prefix_trees(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", path: str | None = None, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """Packed rows (ids, nodes, convs) of all conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(vocabulary(path))
        for batch in batches:
            upto, at = np.cumsum(np.asarray(batch.column("size"))), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, side="right")))
                some = list(zip(*[batch.column(x).slice(at, to - at).to_pylist() for x in ("conv_id", "path", "roles", "texts")]))
                at = to
                paths = [[p[k : k + 16] for k in range(0, len(p), 16)] for _, p, _, _ in some]
                # What a conversation shares with the one before it needs no encoding, unless a row begins with it.
                fresh = packer.shared(paths[0])
                wanted: list[str] = []
                for k, (_, _, _, texts) in enumerate(some):
                    if k:
                        fresh = next((n for n, (a, b) in enumerate(zip(paths[k - 1], paths[k])) if a != b), min(len(paths[k - 1]), len(paths[k])))
                    wanted += texts[fresh:]
                packer.learn(wanted)
                for digests, (c, _, roles, texts) in zip(paths, some):
                    packer.add(c, digests, roles, texts)
                    if packer.tokens >= most_tokens:
                        packer.end()
                        if sum(packer.rows[0]) >= MOST_OUT:
                            yield packer.batch()
        if packer.held:
            packer.end()
        if packer.rows[0]:
            yield packer.batch()

    order = [F.col("path"), F.col("conv_id")]
    return conversations(turns, conv_id, turn, role, text).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, PACKED)


def vocabulary(path: str | None) -> str:
    """The tokenizer's file, found where the task runs."""
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def read_back(packed: DataFrame, path: str | None = None) -> DataFrame:
    """(conv_id, formatted, turns, loss_text) of every conversation, from the packed rows alone."""
    schema = "conv_id long, formatted string, turns array<struct<role:string,text:string>>, loss_text string"
    kinds = [pa.int64(), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = tokenizer(vocabulary(path)).decode_batch
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column("ids")[k].values.to_numpy()
                nodes, convs = batch.column("nodes")[k].values, batch.column("convs")[k].values
                start, length, parent, lo, hi = (nodes.field(n).to_pylist() for n in ("start", "length", "parent", "loss_start", "loss_end"))
                # The parts before, under and after the loss mask, which starts and ends between tokens.
                cuts = [(s, a, b, s + n) if b > a else (s, s + n, s + n, s + n) for s, n, a, b in zip(start, length, lo, hi)]
                parts = decode([ids[c[x] : c[x + 1]].tolist() for c in cuts for x in range(3)], skip_special_tokens=False)
                whole = ["".join(parts[3 * n : 3 * n + 3]) for n in range(len(cuts))]
                loss = [unescaped(parts[3 * n + 1]) for n in range(len(cuts))]
                said = [parsed(w)[0] for w in whole]
                out, chars = [], 0
                for c, leaf in zip(convs.field("conv_id").to_pylist(), convs.field("leaf").to_pylist()):
                    chain = []
                    while leaf >= 0:
                        chain.append(leaf)
                        leaf = parent[leaf]
                    chain.reverse()
                    text = "".join(whole[n] for n in chain)
                    out.append((c, text, [{"role": said[n][0], "text": said[n][1]} for n in chain], "".join(loss[n] for n in chain)))
                    chars += len(text)
                    if chars > MOST_OUT:
                        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], ["conv_id", "formatted", "turns", "loss_text"])
                        out, chars = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], ["conv_id", "formatted", "turns", "loss_text"])

    return packed.mapInArrow(run, schema)


def digest(turns: list[tuple[str, str]]) -> str:
    """The SHA-256 of role, newline, text, newline of each turn."""
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
