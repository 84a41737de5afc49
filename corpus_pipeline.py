"""The corpus pipeline: documents are filtered by toxicity and language, deduplicated, decontaminated and packed.

Every stage takes what the stage before kept, as a Parquet table, and its decisions take effect. Models are trained on the
labelled rows of the tables in sf_dir. All stages but the last return the columns of their input. What a stage writes to the shared
folder stays until the driver ends, as its result, and whatever is derived from it, reads it; `run` drops it once the result itself is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontaminate, langid, packing, similar, toxicity
from lexloom.llm.common import drop_folder, made_so_far, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 5 does not predict toxic. Null and empty texts stay."""
    return toxicity.keep_clean(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 9 finds to be in a learned language; those without a letter or without a clear language go."""
    return langid.keep_known(docs, langid.train(table(spark, sf_dir, "documents")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least id, of each group that similarities of 0.8 or more over five-word shingles link."""
    return similar.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which operator 4 finds no window of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the pieces of all documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Trained models, fingerprints and token ids are beyond SQL; a test compares the near-duplicate stage's kept ids with brute force, the others' operators have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = set(made_so_far())
        docs, folder = written(stage(spark, docs, sf_dir), f"stage-{name}")
        for scratch in set(made_so_far()) - before - {folder}:
            drop_folder(spark, scratch)
    return STAGES[-1][1](spark, docs, sf_dir)
