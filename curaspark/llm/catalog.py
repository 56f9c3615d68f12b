"""Registered queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from curaspark.llm import bpe_count, bilinear_lm, byte_codec, hamming_index, line_quality, passage_chains, piece_codec, plane_resampling, prefix_trie, reply_trees, signature_join, source_mix, toxicity
from curaspark.llm.twins import ORACLES

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return signature_join.linked_sets(table(spark, folder, "documents"))


def op2_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    return piece_codec.digests(table(spark, folder, "documents"), public_tokenizers.path(PIECE_MODEL))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    scored = toxicity.scores(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_count.token_counts(table(spark, folder, "documents"), public_tokenizers.path(BYTE_MODEL))


def op5_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    return line_quality.verdicts(table(spark, folder, "documents"))


def op6_passage_chains(spark: SparkSession, folder: str) -> DataFrame:
    found = passage_chains.passages(passage_chains.pieces(table(spark, folder, "documents")))
    return found.select(
        F.col("doc").alias("doc_id"), F.col("start").alias("start_word"), (F.col("stop") - F.col("start")).alias("n_words"),
        F.col("source").alias("source_doc_id"), F.col("sources").alias("source_doc_ids"), F.col("same").alias("same_words"),
    )


def op7_reply_trees(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    messages = reply_trees.chains(rows.unionByName(probe), "conv_id", ["turn"])
    done = reply_trees.conversations(messages)
    return reply_trees.read_back(done).withColumnRenamed("tree", "conv_id")


def op8_bilinear_lm(spark: SparkSession, folder: str) -> DataFrame:
    return bilinear_lm.scores(table(spark, folder, "documents"))


def op9_hamming_index(spark: SparkSession, folder: str) -> DataFrame:
    return hamming_index.near_duplicates(table(spark, folder, "embeddings"))


def op10_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return source_mix.mix_table(table(spark, folder, "documents"))


def op11_plane_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = plane_resampling.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    own = prefix_trie.turn_lists(table(spark, folder, "conversations"))
    base = own.select(F.col("conv").alias("base"), F.col("turns").alias("base_turns"))
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).cast("int")
    rebuilt = own.withColumn("base", F.col("conv") - F.col("conv") % 5).join(base, "base", "left").select(
        "conv",
        F.concat(
            F.coalesce(F.slice("base_turns", 1, head), F.slice("turns", 1, 0)), F.slice("turns", head + 1, F.size("turns"))
        ).alias("turns"),
    )
    return prefix_trie.nodes(rebuilt).drop("prefix")


def op13_byte_codec(spark: SparkSession, folder: str) -> DataFrame:
    return byte_codec.digests(table(spark, folder, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_piece_codec": op2_piece_codec,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_line_quality": op5_line_quality,
    "op6_passage_chains": op6_passage_chains,
    "op7_reply_trees": op7_reply_trees,
    "op8_bilinear_lm": op8_bilinear_lm,
    "op9_hamming_index": op9_hamming_index,
    "op10_source_mix": op10_source_mix,
    "op11_plane_resampling": op11_plane_resampling,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_byte_codec": op13_byte_codec,
    "pipeline": corpus_pipeline.run,
}
