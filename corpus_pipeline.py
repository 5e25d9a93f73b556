"""From raw documents to a training mix, one written stage after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import decontamination, language, mixing, simhash, substrings
from tallyframe.llm import toxicity as toxic_text
from tallyframe.llm.components import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores as toxic go.

    Learns from the labels outside the held-out fold; null and empty texts stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(language.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    scored = toxic_text.score_toxicity(docs, labels.filter(~held_out), carry=True)
    return scored.filter("predicted = 0").select("row.*").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (three-word shingles, three bits) the document with the smallest id stays.

    Texts without words are one group.
    """
    return simhash.one_per_component(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the words of passages that stand elsewhere, too; n_chars follows.

    No document goes; one that loses nothing keeps its text as it is, null included.
    """
    found = substrings.dedup_substrings(docs, carry=True)
    size = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))
    columns = [F.col("kept_text").alias(c) if c == "text" else size.alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
               for c in docs.columns]
    return found.select(*columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with edits, go."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: sizes, targets, copies and words taken."""
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
]

#: Character models, fingerprints, edit distances and random rounding have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read as the next input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
