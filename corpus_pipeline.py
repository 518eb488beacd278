"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each as Parquet in the shared folder and hands the rows read back to the next.
All but the last return the columns of `documents`, whatever their names.

Defined results: rows with null or empty texts stay until near duplicates, where
they are one class by their equal (empty) text; of repeated rows one stays;
without labels of both classes nothing is rejected as toxic unless most training
labels are, and without good labels nothing is rejected for quality; an empty
benchmark rejects nothing; an empty table of documents gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factframe.llm import decontaminate, kneser_ney, order_minhash, packing, resample
from factframe.llm.common import free_name, written
from factframe.llm.queries import tokenizer


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half stay."""
    model, score = kneser_ney.fit(docs, _table(spark, sf_dir, "labels")), free_name(docs, "toxic_score")
    return kneser_ney.with_toxicity(docs, model, score).where(F.col(score) < 0.5).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling stay: as large a share as is good among the training labels."""
    return resample.keep_resampled(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one of least doc_id."""
    return order_minhash.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.remove_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document left gets its length bucket, batch and slot; lengths are token ids."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Trained models and sketches have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
