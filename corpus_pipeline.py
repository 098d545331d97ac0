"""A corpus pipeline of four stages over ``documents``: toxicity, near-duplicates, decontamination, packing.

Each stage reads what its predecessor wrote. Toxicity drops documents scored 0.7 or more; near-dedup keeps the smallest
doc_id of each group; decontamination cuts benchmark passages out of the texts and drops documents that consist of them
mostly or hold several; packing returns one row for each piece of a document in its sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris.llm.decontam import decontaminate
from verdigris.llm.near_dedup import deduplicate
from verdigris.llm.packing import best_fit_packing
from verdigris.llm.toxicity import fit, reject_toxic, remainder
from verdigris.session import load, materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, fit(docs, load(spark, sf_dir, "labels"), remainder() != 1))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, load(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]
#: SQL has neither the trees nor the tokenizer; tests/llm compares the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again but the last."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
