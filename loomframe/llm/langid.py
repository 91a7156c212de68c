"""Language identification with bit-sliced Bloom filters over letter trigrams.

Training counts trigrams per language over all training rows. A language contains those that make up
at least `least_share` of its trigrams (so 1 / least_share of them at most; rarer ones are names and
quotations in other languages). Each sets its language's bit in `probes` of the filter's slots; a slot
has a bit for each language, in as many 62-bit words as they need, so one look-up returns every language
that contains the trigram. The filter has a fixed number of slots.

A text's trigrams are looked up; each language's hits are counted over the bits returned and the
count is corrected for that language's false-positive rate; the largest corrected share wins.

Defined results: null text or a text without a letter: `und`, score 0; no known trigram: the
language with most training rows, score 0; ties: the one with more training rows, then by code
point; texts of any length are whole; nothing to learn from: `und`; repeated rows are all returned; any number of languages, the model
holding a bit for each in every slot; a kept column named as one of the results raises.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import dropped, mixed, sliced, written

SLOTS, PROBES, LEAST_SHARE = 1 << 20, 3, 1e-5
UNKNOWN = "und"
#: Languages in a word of a slot.
WORD_BITS = 62


@functools.cache
def letters() -> np.ndarray:
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(packed trigrams, index of their text). A trigram is a letter with its neighbours; what is not a letter is a blank."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    clean = np.where(is_letter, codes, 32).astype(np.uint64)
    at = np.flatnonzero(is_letter)
    packed = (clean[at - 1] << np.uint64(42)) | (clean[at] << np.uint64(21)) | clean[at + 1]
    ends = np.cumsum([len(t) + 1 for t in low])
    return packed, np.searchsorted(ends, at - 1, side="right")


def slots_of(packed: np.ndarray, probe: int, slots: int) -> np.ndarray:
    return (mixed(packed + np.uint64((0x9E3779B97F4A7C15 * (probe + 1)) % (1 << 64))) % np.uint64(slots)).astype(np.int64)


class Model:
    """languages (a bit each, most training rows first) and the filter's slots: a row of them for each word."""

    def __init__(self, languages: list[str], masks: np.ndarray, probes: int = PROBES) -> None:
        self.languages, self.masks, self.probes = languages, masks, probes
        fill = np.array([np.count_nonzero(self.bit(masks[k // WORD_BITS], k)) / masks.shape[1] for k in range(len(languages))])
        self.false_rate = np.minimum(fill**probes, 0.99)

    @staticmethod
    def bit(word: np.ndarray, k: int) -> np.ndarray:
        return (word >> np.uint64(k % WORD_BITS)) & np.uint64(1) > 0

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(trigrams of each text, of them those that each language contains: a row for each language)."""
        packed, own = trigrams(texts)
        slots = [slots_of(packed, k, self.masks.shape[1]) for k in range(self.probes)]
        out = np.zeros((len(self.languages), len(texts)), np.int64)
        for w, word in enumerate(self.masks):
            found = np.bitwise_and.reduce([word[s] for s in slots])
            for k in range(w * WORD_BITS, min((w + 1) * WORD_BITS, len(self.languages))):
                out[k] = np.bincount(own[self.bit(found, k)], minlength=len(texts))
        return np.bincount(own, minlength=len(texts)), out

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        n, hits = self.hits(texts)
        share = hits / np.maximum(n, 1)
        share = np.clip((share - self.false_rate[:, None]) / (1 - self.false_rate[:, None]), 0, 1)
        best = np.argmax(share, axis=0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, n)], np.where(n > 0, share[best, np.arange(len(texts))], 0.0).tolist()


def train(rows: DataFrame, text: str = "text", lang: str = "lang", slots: int = SLOTS, probes: int = PROBES, least_share: float = LEAST_SHARE) -> Model:
    """A model of all rows with a language; a row for each language and for each slot in use reach the driver."""
    spark = rows.sparkSession
    rows = rows.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            packed, own = trigrams(batch.column("text").to_pylist())
            coded = batch.column("lang").dictionary_encode()
            which = np.asarray(coded.indices)
            for k, name in enumerate(coded.dictionary.to_pylist()):
                grams, n = np.unique(packed[which[own] == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * (len(grams) + 1)), pa.array(np.append(grams, np.uint64(0)).view(np.int64)), pa.array(np.append(n, np.count_nonzero(which == k)))], ["lang", "gram", "n"])

    # gram 0 carries the number of rows
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "trigrams")
    totals = counts.groupBy("lang").agg(F.sum(F.when(F.col("gram") != 0, F.col("n")).otherwise(0)).alias("total"), F.sum(F.when(F.col("gram") == 0, F.col("n")).otherwise(0)).alias("docs"))
    languages = sorted(totals.collect(), key=lambda x: (-x["docs"], x["lang"]))
    names = [x["lang"] for x in languages]
    words = max(1, -(-len(names) // WORD_BITS))
    masks = np.zeros((words, slots), np.uint64)
    if not names:
        return Model([], masks, probes)
    bits = spark.createDataFrame([(x["lang"], k // WORD_BITS, 1 << (k % WORD_BITS), max(1, x["total"])) for k, x in enumerate(languages)], "lang string, word int, bit long, total long")
    # A row for each language of the model.
    common = counts.where("gram != 0").join(F.broadcast(bits), "lang").where(F.col("n") / F.col("total") >= least_share)
    sets = common.groupBy("gram", "word").agg(F.bit_or("bit").alias("mask"))

    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = np.asarray(batch.column("gram")).view(np.uint64)
            for k in range(probes):
                yield pa.RecordBatch.from_arrays([pa.array(slots_of(grams, k, slots)), batch.column("word"), batch.column("mask")], ["slot", "word", "mask"])

    for r in sets.mapInArrow(insert, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
        masks[r["word"], r["slot"]] = r["mask"]
    dropped(counts)
    return Model(names, masks, probes)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score; whole texts, no shuffle."""
    clash = {c.lower() for c in keep} & {"lang_pred", "score", "_text"}
    if clash:
        raise ValueError(f"the results have columns named {sorted(clash)} themselves")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            names, scores = shared.value.score(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["lang_pred string", "score double"]))
