"""The registered queries of the text operators, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontaminate, langid, lmscore, mixing, neardup, packing, quality, repair, substring, tokens, toxicity
from .common import crc_mod
from .oracles import ORACLES

#: Weights of the sources in code-point order, repeated.
SOURCE_WEIGHTS = [3.0, 1.0, 2.0]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.occurrences(docs, _read(spark, sf_dir, "benchmark"), window=10, keep=["doc_id"])
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, "word_bpe_49k.json", limit=2048, keep=["doc_id"])


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_chat(turns)).drop("valid")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    index = toxicity.train(docs, _read(spark, sf_dir, "labels"), ~held_out)
    held = docs.select("doc_id", "text", held_out.alias("held_out"))
    return toxicity.score(held, index, keep=["doc_id", "held_out"])


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, words=4, percent=80)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs, window=13)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = langid.train(docs, ~held_out)
    held = docs.select("doc_id", "text", held_out.alias("held_out"))
    return langid.predict(held, model, keep=["doc_id", "held_out"])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, SOURCE_WEIGHTS).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return lmscore.train_and_score(docs, crc_mod("doc_id", 5) == 1)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, "word_bpe_49k.json", 2048, keep=["doc_id"])


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return centroids.cluster_vectors(vectors, k=8, rounds=10, dims=64, scale=1024, seed="3", keep=["vec_id"])


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(_read(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_tokens": op2_tokens,
        "op3_chat": op3_chat,
        "op4_toxicity": op4_toxicity,
        "op5_near_dedup": op5_near_dedup,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_language": op7_language,
        "op8_mixing": op8_mixing,
        "op9_lm_score": op9_lm_score,
        "op10_quality": op10_quality,
        "op11_packing": op11_packing,
        "op12_centroids": op12_centroids,
        "op13_repair": op13_repair,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
