"""The training-text pipeline: each stage calls one operator on all that the stage before it kept."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachloom.llm import decontaminate, mixing, neardup, substring, toxicity
from reachloom.llm.queries import SOURCE_WEIGHTS
from reachloom.storage import Scratch, saved, trim_driver

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Scratch tables of the stage that ran last.
_last: list[Scratch] = []


def stage(made):
    """Each stage's result is written before the next stage begins, which then deletes the scratch tables it came from.
    The first stage deletes nothing: the last one's result may still be unread."""

    @functools.wraps(made)
    def step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if made.__name__ != "drop_toxic":
            for scratch in _last:
                scratch.delete()
        _last[:] = [Scratch(spark)]
        trim_driver(spark)  # the plans of one stage leave the driver's process larger for all that follow
        with _last[0]:
            return made(spark, docs.select(*COLUMNS), sf_dir)

    return step


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't call toxic (score under 0.7)."""
    index = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return toxicity.score(docs, index, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies. Rows of equal id and text are one document and
    stay together."""
    own = F.xxhash64("text").alias("__print")
    groups = neardup.near_duplicates(docs.select("doc_id", "text", own), carry=["__print"])
    kept = groups.where("kept").select(F.col("doc_id").alias("__id"), F.col("__print").alias("__p"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__p"))
    return docs.join(kept, same, "left_semi").select(*COLUMNS)


@stage
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that a smaller id has. Untouched texts stay as they are; documents that lose
    every word go."""
    cut = substring.remove_repeats(docs, window=13, carry=["lang", "source", "n_chars"], with_text=True)
    left = cut.where("n_removed = 0 OR n_removed < n_words")
    length = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", length.alias("n_chars"))


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    hits = decontaminate.occurrences(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS)
    return hits.where("NOT contaminated").select(*COLUMNS)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; `copy` counts from 1."""
    mixed = mixing.mix(docs, SOURCE_WEIGHTS, carry=["text", "lang", "n_chars"])
    rows = mixed.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*COLUMNS, "copy")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The stages' hashes, scores and signatures have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, made in STAGES[:-1]:
        docs = saved(made(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
