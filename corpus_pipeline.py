"""Training-data pipeline over ``documents``: quality, near duplicates, personal data, packing.

Every stage works on all that its predecessor kept, written as Parquet and read again; its decisions take
effect.  All stages but the last return the columns of ``documents``.

Defined cases, for every stage: null texts count as empty, an empty table gives an empty one, columns beyond
those of ``documents`` are carried along by all stages but the last and never read.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portvigil.llm import packing, pii, quality, simhash
from portvigil.storage import written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of at least one half).

    Rows that repeat an id, or have none, are judged each by its own text.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.withColumn("kept_hash", simhash.text_hash(F.col("text")))
    scored = quality.score(rows, labels, carried=("kept_hash",)).where("predicted = 1")
    kept = scored.select(F.col("doc_id").alias("kept_id"), F.col("kept_hash").alias("text_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("kept_hash") == F.col("text_hash"))
    return rows.join(kept, same, "left_semi").drop("kept_hash")


#: Candidates of near copies: fingerprints of two-word shingles that differ in at most 7 bits under one of two seeds.
#: Only those whose five-word shingles are alike to 0.8 are copies; README.md has the measured share that is found.
COPY_WORDS, COPY_BITS, COPY_SEEDS = 2, 7, (42, 43)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document of smallest id, of smallest text hash among those.

    Two texts are near duplicates when their sets of five-word shingles are alike to 0.8; SimHash proposes them.
    Rows that repeat an id and a text are one document; with another text they are told apart.  Null ids come last.
    """
    found = simhash.one_of_alike(docs, words=COPY_WORDS, bits=COPY_BITS, seeds=COPY_SEEDS)
    first = found.withColumnRenamed("doc_id", "kept_id")
    rows = docs.withColumn("kept_hash", simhash.text_hash(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("kept_hash") == F.col("text_hash"))
    return rows.join(first, same, "left_semi").dropDuplicates(["doc_id", "kept_hash"]).drop("kept_hash")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars is that of the new text."""
    redacted = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return redacted
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_filter),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: Trained models and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
