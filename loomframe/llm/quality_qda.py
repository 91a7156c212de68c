"""A quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of a whole text (lengths, symbol, case, digit and punctuation rates, repetition, line
endings) are transformed by logarithms and square roots. Class counts, sums and cross products are
summed over all training rows; only these d x d moments reach the driver. Class covariances shrink
towards the pooled one and its diagonal; scores are logistic values of the difference of Gaussian
log densities, from Mahalanobis distances by cached inverse Cholesky factors.

Defined results: null and empty texts have all-zero counts and get a score like any other; labels
other than 0 and 1 and null labels teach nothing; repeated labels of a document count by their
majority (a tie is 1); with one class only, every score is that class's share; with no labels 0.5;
repeated rows are all returned; texts of any length are whole; an empty table gives an empty table; other
columns of documents and labels are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.llm.common import mixed, sliced, split_words

NAMES = ("words", "word_length", "symbols", "bars", "shouts", "upper", "digits", "stops", "again", "distinct", "open_lines", "longest")
#: Share of the class covariance given to the pooled one, and of both given to its diagonal.
TO_POOLED, TO_DIAGONAL = 0.1, 0.1
THRESHOLD = 0.3
#: Words of usual length and no marks that every text is taken to have besides its own, so that rates of short texts stay near the mean.
PRIOR_WORDS, PRIOR_LENGTH = 12, 5

_KINDS = ("#*$%&<>", "|", "!?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:")
_CLASS = np.zeros((len(_KINDS), 256), bool)
for _k, _chars in enumerate(_KINDS):
    _CLASS[_k, [ord(c) for c in _chars]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?:;\"')"]] = True
_END[0x80:] = False


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text."""
    texts = pc.fill_null(texts, "")
    size = np.asarray(pc.binary_length(texts)).astype(np.int64)
    raw = np.frombuffer(b"\n".join([t.as_buffer().to_pybytes() for t in texts] + [b""]), np.uint8)
    starts = np.concatenate([[0], np.cumsum(size + 1)])
    bounds = starts[:-1]
    offsets, words = split_words(texts)
    n = np.diff(offsets)
    each = n + PRIOR_WORDS
    if not len(texts):
        return np.zeros((0, len(NAMES)))
    rates = [np.add.reduceat(_CLASS[k][raw].astype(np.int64), bounds) / each for k in range(len(_KINDS))]
    solid = np.add.reduceat((~_BLANK[raw] & ((raw & 0xC0) != 0x80)).astype(np.int64), bounds)
    # Lines: the last solid byte before each line end, if the line has one, should close a sentence.
    last = np.maximum.accumulate(np.where(_BLANK[raw], -1, np.arange(len(raw))))
    stop = np.flatnonzero(raw == 10)
    begin = np.concatenate([[-1], stop[:-1]])
    filled = last[stop] > begin
    is_open = filled & ~_END[raw[np.maximum(last[stop], 0)]]
    owner = np.searchsorted(starts, stop, side="right") - 1
    lines = np.bincount(owner[filled], minlength=len(n))
    opened = np.bincount(owner[is_open], minlength=len(n)) / (lines + 1)
    coded = words.dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashes = known[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.uint64)
    width = 3
    rolled = hashes
    if len(hashes) >= width:
        m = len(hashes) - width + 1
        rolled = mixed(hashes[:m])
        for k in range(1, width):
            rolled = mixed(rolled + hashes[k : m + k] * np.uint64(2 * k + 1))
    again, distinct = np.zeros(len(n)), np.ones(len(n))
    for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if hi - lo > width:
            again[i] = (hi - lo - width + 1 - len(np.unique(rolled[lo : hi - width + 1]))) / (hi - lo + PRIOR_WORDS)
        if hi > lo:
            distinct[i] = (len(np.unique(hashes[lo:hi])) + PRIOR_WORDS) / (hi - lo + PRIOR_WORDS)
    longest = np.zeros(len(n))
    if len(words):
        length = np.asarray(pc.utf8_length(words)).astype(np.int64)
        full = np.flatnonzero(n)
        longest[full] = np.maximum.reduceat(length, offsets[full])
    symbols, bars, shouts, upper, digits, stops = rates
    columns = [np.log1p(n), np.log1p((solid + PRIOR_WORDS * PRIOR_LENGTH) / each), np.sqrt(symbols), np.sqrt(bars), np.sqrt(shouts), np.sqrt(upper), np.sqrt(digits), np.sqrt(stops), np.sqrt(again), distinct, np.sqrt(opened), np.log1p(np.maximum(longest, 2 * PRIOR_LENGTH))]
    return np.stack(columns, axis=1)


def featured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            x = statistics(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


class Model:
    """Means, inverse Cholesky factors and log terms of both classes."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, crosses: np.ndarray, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> None:
        total = counts.sum()
        self.share = float(counts[1] / total) if total else 0.5
        self.parts: list[tuple[np.ndarray, np.ndarray, float]] = []
        if not counts.all():
            return
        means = sums / counts[:, None]
        within = [crosses[k] / counts[k] - np.outer(means[k], means[k]) for k in (0, 1)]
        pooled = sum(w * c for w, c in zip(within, counts)) / total
        spread = np.diag(crosses.sum(axis=0)) / total - (sums.sum(axis=0) / total) ** 2
        scale = np.sqrt(np.maximum(spread, 1e-6))
        for k in (0, 1):
            cov = (1 - to_pooled) * within[k] + to_pooled * pooled
            cov = cov / np.outer(scale, scale)
            cov = (1 - to_diagonal) * cov + to_diagonal * np.eye(len(scale))
            low = np.linalg.cholesky(cov)
            inverse = np.linalg.solve(low, np.eye(len(scale))) / scale[None, :]
            self.parts.append((means[k], inverse, float(np.log(counts[k] / total) - np.log(np.diag(low)).sum())))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), self.share)
        zero, one = (c - 0.5 * (((x - m) @ inverse.T) ** 2).sum(axis=1) for m, inverse, c in self.parts)
        return 1 / (1 + np.exp(np.clip(zero - one, -500, 500)))


def majority(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    rows = labels.where(F.col(f"`{label}`").isin(0, 1)).groupBy(F.col(f"`{doc_id}`").cast("long").alias("doc_id"))
    return rows.agg((F.avg(F.col(f"`{label}`")) >= 0.5).cast("int").alias("y"))


def fit(features: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", **shrinkage: float) -> Model:
    """A model of all labelled rows of `features`."""
    d = len(NAMES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = np.asarray(batch.column("y"))
            x = np.asarray(batch.column("x").flatten()).reshape(-1, d)
            for k in (0, 1):
                z = x[y == k]
                total[k] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([k] * total.shape[1], pa.int32()), pa.array(np.arange(total.shape[1]), pa.int32()), pa.array(total[k])], ["y", "at", "v"])

    taught = features.join(majority(labels, doc_id, label), "doc_id").select("x", "y")
    out = np.zeros((2, 1 + d + d * d))
    for r in taught.mapInArrow(moments, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect():
        out[r["y"], r["at"]] = r["v"]
    return Model(out[:, 0], out[:, 1 : 1 + d], out[:, 1 + d :].reshape(2, d, d), **shrinkage)


def scored(features: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row of `features`."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(NAMES))
            score = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return features.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")


def judged(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted, in one pass over the texts; a clash of names raises."""
    clash = {"score", "predicted"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"the input already has {sorted(clash)}")
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            score = shared.value.score(statistics(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
