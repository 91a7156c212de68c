"""Row patterns: regular expressions over ordered rows, matched over chunks so that a hot key is split.

A pattern has symbols (single letters, each a condition on a row; a row has the first one that holds), and after
each or after parentheses + * ? {m} {m,} {m,n}; | between alternatives. It compiles to a position automaton.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.operators.ranges import numbered, same
from loomframe.sources.stages import stage

#: Rows whose symbols make one string.
CHUNK = 1 << 16
#: About how many matches make a frame.
FRAME = 1 << 17
#: A row that no condition holds for.
OTHER = "."


@dataclass(frozen=True)
class Part:
    """A piece of a pattern by positions: those it may begin and end with, and whether it may be empty."""

    first: frozenset[int]
    last: frozenset[int]
    empty: bool


class Automaton:
    """States are the pattern's symbol positions, and 0 before any. `after[q]` are the positions that may follow q."""

    def __init__(self, pattern: str) -> None:
        self.tokens = re.findall(r"[A-Za-z]|\{\d+(?:,\d*)?\}|[()|+*?]|\S", pattern)
        self.at = 0
        self.symbols: list[str] = [""]
        self.after: list[set[int]] = [set()]
        whole = self.alternatives()
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at]!r} in the pattern")
        if whole.empty:
            raise ValueError("the pattern matches no rows at all")
        self.after[0] |= whole.first
        self.accepts = whole.last

    def alternatives(self) -> Part:
        found = self.sequence()
        while self.peek() == "|":
            self.at += 1
            other = self.sequence()
            found = Part(found.first | other.first, found.last | other.last, found.empty or other.empty)
        return found

    def sequence(self) -> Part:
        found = Part(frozenset(), frozenset(), True)
        while self.peek() not in (None, "|", ")"):
            found = self.joined(found, self.repeated())
        return found

    def joined(self, a: Part, b: Part) -> Part:
        for q in a.last:
            self.after[q] |= b.first
        return Part(a.first | b.first if a.empty else a.first, a.last | b.last if b.empty else b.last, a.empty and b.empty)

    def repeated(self) -> Part:
        begin = self.at
        part = self.single()
        end = self.at
        token = self.peek()
        if token is None or token not in "+*?" and not token.startswith("{"):
            return part
        self.at += 1
        least, most = {"+": (1, None), "*": (0, None), "?": (0, 1)}.get(token) or self.bounds(token)
        if most == 0:
            return Part(frozenset(), frozenset(), True)
        # each further time is a copy with positions of its own
        resume, copies = self.at, [part]
        for _ in range((most or max(least, 1)) - 1):
            self.at = begin
            copies.append(self.single())
            assert self.at == end
        self.at = resume
        if most is None:
            for q in copies[-1].last:
                self.after[q] |= copies[-1].first
        found = Part(frozenset(), frozenset(), True)
        for k, copy in enumerate(copies):
            found = self.joined(found, copy if k < least else Part(copy.first, copy.last, True))
        return found

    def bounds(self, token: str) -> tuple[int, int | None]:
        least, comma, most = token[1:-1].partition(",")
        upper = int(most) if most else None if comma else int(least)
        if upper is not None and upper < int(least):
            raise ValueError(f"{token} ends before it begins")
        return int(least), upper

    def single(self) -> Part:
        token = self.peek()
        self.at += 1
        if token == "(":
            part = self.alternatives()
            if self.peek() != ")":
                raise ValueError("a parenthesis isn't closed")
            self.at += 1
            return part
        if token is None or not token.isalpha():
            raise ValueError(f"unexpected {token!r} in the pattern")
        self.symbols.append(token)
        self.after.append(set())
        return Part(frozenset([len(self.symbols) - 1]), frozenset([len(self.symbols) - 1]), False)

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    @functools.cached_property
    def steps(self) -> dict[str, list[tuple[int, list[int]]]]:
        """By symbol: (q, the positions with that symbol that may follow q)."""
        out: dict[str, list[tuple[int, list[int]]]] = {}
        for symbol in set(self.symbols[1:]):
            moves = [(q, sorted(p for p in self.after[q] if self.symbols[p] == symbol)) for q in range(len(self.symbols))]
            out[symbol] = [(q, ps) for q, ps in moves if ps]
        return out

    # Ends are places (row numbers) of a match's last row; -1 is none. `ends[q]`: the farthest end of a match
    # that is in state q before a row.

    def back(self, symbol: str, place: int, ends: list[int]) -> list[int]:
        """The ends before the row at a place, from those after it."""
        before = [place - 1 if q in self.accepts else -1 for q in range(len(self.symbols))]
        for q, ps in self.steps.get(symbol, ()):
            before[q] = max(before[q], *[ends[p] for p in ps])
        return before

    def final(self, place: int) -> list[int]:
        """The ends where no row follows the one at place - 1."""
        return [place - 1 if q in self.accepts else -1 for q in range(len(self.symbols))]

    def summary(self, symbols: str, first: int) -> tuple[list[int], list[int]]:
        """What a chunk makes of the ends after it: (by state a bit mask of the states that those come from, the
        farthest end within the chunk)."""
        n = len(self.symbols)
        reach = [1 << q for q in range(n)]
        own = [-1] * n
        for k in range(len(symbols) - 1, -1, -1):
            ends = self.back(symbols[k], first + k, own)
            masks = [0] * n
            for q, ps in self.steps.get(symbols[k], ()):
                for p in ps:
                    masks[q] |= reach[p]
            own, reach = ends, masks
        return reach, own

    def composed(self, reach: list[int], own: list[int], after: list[int]) -> list[int]:
        """The ends before a chunk, from its summary and the ends after it."""
        return [max(own[q], *[after[p] for p in range(len(after)) if reach[q] >> p & 1], -1) for q in range(len(own))]

    @functools.cached_property
    def moved(self) -> Callable[[str, tuple[int, ...]], tuple[int, ...]]:
        """`back` for ends counted from the row before a place (-1: none), so that rows alike share a step."""

        @functools.lru_cache(maxsize=1 << 16)
        def step(symbol: str, ends: tuple[int, ...]) -> tuple[int, ...]:
            return tuple(self.back(symbol, 1, [e + 1 if e >= 0 else -1 for e in ends]))

        return step

    def starts(self, symbols: str, first: int, after: list[int]) -> tuple[list[int], list[int]]:
        """(by row the farthest end of a match that starts there or -1, the ends before the chunk)."""
        last, moved, found = first + len(symbols) - 1, self.moved, [-1] * len(symbols)
        ends = tuple(e - last if e >= 0 else -1 for e in after)
        for k in range(len(symbols) - 1, -1, -1):
            ends = moved(symbols[k], ends)
            if ends[0] > 0:
                found[k] = first + k - 1 + ends[0]
        return found, [e + first - 1 if e >= 0 else -1 for e in ends]


def chain(found: list[int], first: int, entry: int) -> Iterator[tuple[int, int]]:
    """The matches (start, end) in a chunk when rows before `entry` are taken: each the first that starts after the last one's end."""
    at = max(entry - first, 0)
    while at < len(found):
        if found[at] >= 0:
            yield first + at, found[at]
            at = found[at] + 1 - first
        else:
            at += 1


def match_rows(df: DataFrame, by: list[str], order: list[str], symbols: dict[str, Column], pattern: str, measures: dict[str, Column], overlapping: bool = False, chunk: int = CHUNK) -> DataFrame:
    """One row for each match: (by, match_start, match_end, measures), places from 0 in the key's order.

    A match is the longest that starts at its row, and the next one starts after its end; `overlapping` gives the
    longest one from every row instead. Measures are aggregates over the matched rows, which have their columns,
    `symbol` and `place` (so F.count_if(F.col("symbol") == "B") counts a symbol's rows). `order` should settle ties.

    Rows are numbered over range partitions; the symbols of `chunk` of them make a string, which is all that the
    automaton reads. Keys of one chunk are matched at once, many in a frame. Passes for the others: each chunk says what it makes of the ends after it, for each state; these summaries, a row
    for a chunk, are composed backwards along a key; each chunk then knows the longest match from each of its rows. A
    match that comes in from before ends where one of its states at the edge ends at the farthest, so a chunk
    can be entered at few places only; for each it says where it is left, and a pass forward along the key picks the
    places that are taken. Matches are joined to their rows by key and place.
    """
    if bad := [s for s in symbols if len(s) != 1 or not s.isalpha()]:
        raise ValueError(f"symbols must be single letters: {bad}")
    if unknown := set(Automaton(pattern).symbols[1:]) - set(symbols):
        raise ValueError(f"symbols of the pattern without a condition: {sorted(unknown)}")
    kind = F.lit(OTHER)
    for symbol, condition in reversed(symbols.items()):
        kind = F.when(condition, symbol).otherwise(kind)
    keys = [f"_k{k}" for k in range(len(by))]
    rows = df.withColumn("symbol", kind)
    rows = stage(numbered(rows, by, order).withColumnRenamed("_at", "place"), "numbered")
    slim = rows.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], "place", "symbol", "_n")
    # all columns of a key as one, so that nulls group with nulls
    slim = slim.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key") if by else F.lit("").alias("key"), "place", "symbol", "_n")
    packed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "symbol"))), lambda x: x["symbol"]), "")

    def texts(of: DataFrame) -> DataFrame:
        return of.groupBy("key", F.floor(F.col("place") / chunk).alias("chunk")).agg(packed.alias("text"))

    single = texts(slim.where(F.col("_n") <= chunk))
    chunks = stage(texts(slim.where(F.col("_n") > chunk)), "chunks")

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(pattern)
        for frame in frames:
            made = [automaton.summary(t, c * chunk) for t, c in zip(frame["text"], frame["chunk"])]
            yield pd.DataFrame({"key": frame["key"], "chunk": frame["chunk"], "n": frame["text"].str.len(), "reach": [[str(m) for m in r] for r, _ in made], "own": [o for _, o in made]})

    def backwards(frame: pd.DataFrame) -> pd.DataFrame:
        automaton = Automaton(pattern)
        frame = frame.sort_values("chunk", ascending=False)
        after: list[list[int]] = []
        ends = automaton.final(int(frame["chunk"].iloc[0]) * chunk + int(frame["n"].iloc[0]))
        for reach, own in zip(frame["reach"], frame["own"]):
            after.append(ends)
            ends = automaton.composed([int(m) for m in reach], list(own), ends)
        return pd.DataFrame({"key": frame["key"], "chunk": frame["chunk"], "after": after})

    ends = chunks.mapInPandas(summed, "key string, chunk long, n long, reach array<string>, own array<long>")
    ends = ends.groupBy("key").applyInPandas(backwards, "key string, chunk long, after array<long>")
    known = stage(chunks.join(ends, ["key", "chunk"]), "known")

    def left_at(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(pattern)
        for frame in frames:
            exits = []
            for c, text, after in zip(frame["chunk"], frame["text"], frame["after"]):
                first = c * chunk
                found, before = automaton.starts(text, first, list(after))
                entries = {first, *(e + 1 for e in before if first <= e + 1 < first + len(text))}
                taken = {}
                for entry in entries:
                    last = functools.reduce(lambda _, m: m[1], chain(found, first, entry), -1)
                    taken[entry] = max(last + 1, first + len(text))
                exits.append(list(itertools.chain.from_iterable(taken.items())))
            yield pd.DataFrame({"key": frame["key"], "chunk": frame["chunk"], "n": frame["text"].str.len(), "exits": exits})

    def forwards(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        at, entered = 0, []
        for c, n, exits in zip(frame["chunk"], frame["n"], frame["exits"]):
            entered.append(at)
            if at < c * chunk + n:
                at = dict(zip(exits[::2], exits[1::2]))[at]
        return pd.DataFrame({"key": frame["key"], "chunk": frame["chunk"], "entry": entered})

    def matched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(pattern)
        found: tuple[list, list, list] = ([], [], [])
        for frame in frames:
            # keys of one chunk have neither ends after it nor an entry
            afters = frame["after"] if "after" in frame else itertools.repeat(None)
            entries = frame["entry"] if "entry" in frame else itertools.repeat(0)
            for key, c, text, after, entry in zip(frame["key"], frame["chunk"], frame["text"], afters, entries):
                first = c * chunk
                ends, _ = automaton.starts(text, first, automaton.final(first + len(text)) if after is None else list(after))
                for start, end in ((first + k, e) for k, e in enumerate(ends) if e >= 0) if overlapping else chain(ends, first, entry):
                    found[0].append(key)
                    found[1].append(start)
                    found[2].append(end)
                if len(found[0]) >= FRAME:
                    yield pd.DataFrame(dict(zip(("key", "match_start", "match_end"), found)))
                    found = ([], [], [])
        if found[0]:
            yield pd.DataFrame(dict(zip(("key", "match_start", "match_end"), found)))

    if overlapping:
        known = known.withColumn("entry", F.lit(0).cast("long"))
    else:
        exits = known.mapInPandas(left_at, "key string, chunk long, n long, exits array<long>")
        known = known.join(exits.groupBy("key").applyInPandas(forwards, "key string, chunk long, entry long"), ["key", "chunk"])
    schema = "key string, match_start long, match_end long"
    matches = single.mapInPandas(matched, schema).union(known.mapInPandas(matched, schema))
    taken = matches.select("key", "match_start", "match_end", F.explode(F.sequence("match_start", "match_end")).alias("place"))
    named = rows.withColumn("key", F.to_json(F.struct(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)]), {"ignoreNullFields": "false"}) if by else F.lit(""))
    found = named.drop("_n").join(taken, ["key", "place"])
    return found.groupBy(*by, "match_start", "match_end").agg(*[c.alias(name) for name, c in measures.items()])
