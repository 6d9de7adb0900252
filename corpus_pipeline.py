"""From raw documents to packed training sequences: five stages, each one operator over all that the last kept.

Every stage but the last returns the columns of documents. Null and empty texts fall to the quality rules; rows
that are equal in every column are copies of each other, of which one stays; an empty table passes through all stages;
extra columns, of any type and name, are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm.common import located, materialize, picked, release, table
from chronotext.llm.decontaminate import decontaminate
from chronotext.llm.packing import pack
from chronotext.llm.pii import redact
from chronotext.llm.quality_rules import keep
from chronotext.llm.simhash import COPY, near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the cascade rejects go."""
    return keep(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10, with links of 5-word Jaccard 0.8 or more: of each component the row with the smallest doc_id stays (null ids last; of
    equal ids the one that is first in the files). A row is known by its file and its place there; whole rows are read again
    only to take those that stay."""
    docs, place = located(docs, "documents")
    groups = near_duplicates(docs.select("doc_id", "text", place.alias("_place")), keep=("_place",), similar=COPY)
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_place")).alias("first"))
    stay = materialize(first.select("first._place.*"), "stay")
    return picked(docs, place, stay)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: personal data becomes its kind in brackets; n_chars follows the text."""
    return redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: a row for each piece of a document, with its sequence and place."""
    return pack(docs, most=2 << 20)  # the executors' memory is nearly all taken


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("pii_redaction", pii_redaction),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprint components, tokens and packing are beyond SQL; the tests compare each stage with a brute-force form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
