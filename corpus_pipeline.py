"""The corpus pipeline: five stages, each one of the corpus operators on all rows the stage before kept.

1. language ID: rows whose language is ``und`` (no text, or no letter in it) go;
   profiles are learned from the stage's own labelled rows;
2. exact dedup: of equal texts the row with the largest doc_id stays;
3. MinHash near-dedup (five-word shingles, similarity 0.8): one row of each component stays;
4. benchmark decontamination: rows in which a benchmark item was found go;
5. best-fit packing: the pieces of what is left, with their sequence and offset.

Every stage but the last returns the columns it was given, and so the columns of ``documents``.
``docs`` is a table read from Parquet at every stage; empty tables pass through, null ids
and texts follow each operator's rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptframe.llm import decontaminate, langid, minhash, packing, stream_dedup
from promptframe.llm.common import materialise, quoted, with_rows
from promptframe.session import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = langid.fit(docs)
    # The predictions get columns beside the documents' own, whatever those are called.
    own = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    text = f"c{docs.columns.index('text')}"
    kept = langid.predict_languages(docs.select(*own), profiles, text).where(F.col("lang_pred") != langid.UNKNOWN)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stream_dedup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_rows(docs, minhash.near_duplicates(docs, size=5).where("first"), "rid", "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL has no way to say the language and packing stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
