"""From raw documents to packed training sequences, in four stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``. The labelled rows that the toxicity model learns from are those of the tables
``labels`` and ``documents`` of ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, mixing, packing, toxicity
from millrace.llm.common import free_name, write_table
from millrace.llm.queries import TOKENIZER


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the rejection threshold. Null and empty texts are scored as texts without words,
    and stay unless the model rejects those; repeated rows are decided alike; without labels, all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(*toxicity.labelled_sample(docs, labels))
    name = free_name(docs, "__toxicity")
    return toxicity.score(docs, model, name=name).where(F.col(name) < toxicity.REJECT).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a five-word Jaccard similarity of 0.8 or more stays,
    that of the smallest doc_id. Rows without an id stay; empty and null texts are copies of each other; of rows that
    repeat the chosen id and text, the first by their other columns stays."""
    return jaccard.first_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by the probabilities that meet the target weights. Nulls count as "other", texts
    without words weigh nothing and are decided by their cell, repeated rows are decided alike."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; null and empty texts are one token long, and
    every row, repeated or without an id, is packed."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("toxicity", reject_toxic), ("near duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences)]

#: SQL can express neither the string-kernel scores nor XXH64 fingerprints; tests/llm/test_pipeline.py
#: compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each earlier stage's are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
