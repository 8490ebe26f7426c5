"""A training corpus from the documents: good, civil, distinct documents, mixed to target weights and packed.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next one's
``docs``; all but the last return the columns of ``documents``. Models learn from the documents that the stage before
has kept. In the mix a document may stand more than once, and part of one may stand alone; the packer takes each row as
a document of its own.

Defined results: a null text counts as empty; empty texts are scored like others, join with nothing, and are not taken by
the mix; rows that repeat a doc_id leave near-dedup as one; rows without a doc_id are kept by it; labels that are null or
belong to no document teach nothing, and without labels the quality stage keeps all (every score is 0.5) and the toxicity
stage too (every score is 0); an empty table stays empty; further columns, whatever their names, are carried to the
packer, which drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import mixing, near_dup, packing, quality, toxicity
from lexiloom.llm.common import written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, _labels(spark, sf_dir))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, _labels(spark, sf_dir))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_first(docs, percent=80, bands=24, rows=5)  # misses (1 - 0.8 ** 5) ** 24 = 0.00007 of the pairs at 0.80


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mixture(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the classifiers, the permutation of the mix or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i + 1}")
    return docs
