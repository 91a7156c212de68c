"""The training-data pipeline over `documents`: quality, near duplicates, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents. Stages work on all
rows that the one before kept; rows that share a doc_id but not their text stay apart.

quality     documents that the classifier rejects go; it learns from the labelled rows of the training folds
near_dups   of each component of near-duplicate texts the row with the smallest doc_id stays, of equal
            rows one; unlike texts of one doc_id are documents of their own; documents without words or
            without a doc_id all stay
repeats     repeated passages are cut out of all documents but the first; a document left without words goes
mixture     one row for each run of words that the mix takes, in the order of the text; n_chars follows
packing     the last stage: one row for each piece, with its sequence and offset
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import jaccard_join, mixing, packing, quality_qda, substring_dedup
from loomframe.llm.common import dropped, kept, scratch
from loomframe.llm.queries import fold, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def worded(text: str) -> Column:
    """Whether a text has a word; looks no further than the first."""
    return F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_qda.fit(quality_qda.featured(docs), table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return quality_qda.judged(docs, model).where("predicted = 1").select(*COLUMNS)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_join(docs, by_text=True)
    kept = found.where("leads").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    named = worded("text") & F.col("doc_id").isNotNull()
    rows = docs.withColumn("_of", F.xxhash64("text"))
    chosen = rows.where(named).join(kept, (F.col("doc_id") == F.col("_id")) & (F.col("_of") == F.col("_mark"))).dropDuplicates(["doc_id", "_of"])
    return chosen.select(*COLUMNS).unionByName(rows.where(~named).select(*COLUMNS))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_substrings(docs)
    found = found.where((F.col("n_removed") == 0) | worded("clean_text"))
    cut = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("clean_text").cast("long"))
    return found.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", cut.alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.Mix(docs).texts(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_dups", near_dups), ("repeats", repeats), ("mixture", mixture), ("packing", pack)]

#: The classifier, the mix and the packing have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a written table, and what it needed besides is deleted after it."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    before = None
    for name, stage in STAGES:
        with scratch(spark):
            docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return docs
