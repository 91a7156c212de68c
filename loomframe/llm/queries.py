"""The opN_ queries over the driver's tables and their SQL twins."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import ball_kmeans, bpe, chat, embed_dedup, jaccard_join, langid, merkle, mixing, packing, quality_qda, quality_rules, sharding, substring_dedup
from loomframe.llm.common import small_batches, written
from loomframe.llm.sql import OP1_SQL, OP2_SQL, OP4_SQL, OP6_SQL, OP7_SQL, OP10_SQL, OP12_SQL, OP13_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver; the session gets small Arrow batches for what the query returns."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.clean_lines(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", "n_failed_lines", F.md5(F.col("clean_text").cast("binary")).alias("clean_md5")
    )


def fold(key: str, folds: int) -> Column:
    """crc32 of an id's decimal text modulo the number of folds."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
    found = chat.read_back(chat.prefix_trees(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).by_document()


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sharding.place(docs, "doc_id").select("doc_id", "source", "slot", "shard")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    taught = docs.where(F.coalesce(fold("doc_id", 3), F.lit(0)) != 1)
    found = langid.identify(docs, langid.train(taught))
    return found.select("doc_id", (F.coalesce(fold("doc_id", 3), F.lit(0)) == 1).alias("held_out"), "lang_pred", "score")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = written(quality_qda.featured(table(spark, sf_dir, "documents").select("doc_id", "text")), "features")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    found = quality_qda.scored(features, quality_qda.fit(features, labels))
    return found.select("doc_id", (F.coalesce(fold("doc_id", 5), F.lit(1)) == 0).alias("held_out"), "score", "predicted")


def op10_substring_dedup(spark: SparkSession, sf_dir: str, anywhere: bool = False) -> DataFrame:
    found = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), anywhere=anywhere)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ";")
    return found.select("doc_id", F.col("clean_text").alias("text"), spans.alias("spans"), "n_units", "n_removed", "removed_words")


def op10_substring_dedup_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_substring_dedup without regard to unit edges; OP10_SQL, which has them, isn't its twin."""
    return op10_substring_dedup(spark, sf_dir, anywhere=True)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.load_ranks(spark, public_tokenizers.path(bpe.RANKS))
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks), ranks)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    found, root = merkle.manifest(docs, "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], {"text": lower}, fold("doc_id", 3) == 0)
    return found.select(
        F.col("id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"),
    )


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, centroids = ball_kmeans.ball_kmeans(table(spark, sf_dir, "embeddings"))
    found = ball_kmeans.with_inertia(members, centroids)
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_source_mixing": op5_source_mixing,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_sharding": op7_sharding,
    "op8_language_id": op8_language_id,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_substring_dedup": op10_substring_dedup,
    "op10_substring_dedup_anywhere": op10_substring_dedup_anywhere,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_ball_kmeans": op13_ball_kmeans,
    "pipeline": pipeline,
}

SQL = {
    "op1_quality_rules": OP1_SQL,
    "op2_jaccard_join": OP2_SQL,
    "op4_chat_formatting": OP4_SQL,
    "op6_embedding_dedup": OP6_SQL,
    "op7_sharding": OP7_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_ball_kmeans": OP13_SQL,
}
