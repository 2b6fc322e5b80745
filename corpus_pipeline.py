"""The corpus pipeline: from raw documents to packed batches.

Each stage reads all that its predecessor kept, and its decisions take
effect: toxic documents go, repeated chunks of lines go, one document of each
group of near duplicates stays, documents with benchmark passages go, and what is left
is packed by length, in tokens. All stages but the last return the columns of documents.

Edge cases, as every stage defines them. Rows with a null or an empty text stay to the end and are packed with
length 0. Rows without an id are judged by their text like all others. Rows that share an id are judged each by
their own text; repeated rows are near duplicates of each other, and one stays. Of equally good candidates
the one with the smallest id stays. Very long texts are read whole. Empty tables give an empty result; without
labels no document is toxic, without a benchmark none is contaminated. Extra columns of documents go along
up to packing, also those with names that a stage adds; they are not part of the last result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stowage.llm import linededup, minhash, packing, spacedseed, toxicity
from stowage.llm.common import folder, removed, table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the severity model rejects."""
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without chunks of lines that stand elsewhere before; every document stays."""
    return linededup.dedup_lines(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near duplicates."""
    return minhash.first_of_groups(docs, percent=80).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold passages of the benchmark."""
    return spacedseed.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A length bucket, a batch and a slot for every document that is left."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", decontaminated), ("packing", packed)]

#: The model, the signatures and the bucket boundaries are no SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next one's input, and then removed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = folder(spark, name)
        docs = written(stage(spark, docs, sf_dir), path)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
