"""The corpus pipeline: documents are filtered, thinned of near copies, masked, mixed and packed into training sequences.

Every stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns the columns of documents; the
last returns pieces in sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veleta.llm.common import small_batches, stored, table
from veleta.llm.mixing import mixed_documents
from veleta.llm.near_dedup import near_copies
from veleta.llm.packing import pack_documents
from veleta.llm.pii import mask_pii
from veleta.llm.quality_model import fit_quality, keep_quality

NEAR_PERCENT = 80  # similarity of near copies that the stage thins

def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from their labels, does not reject."""
    small_batches(spark)
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def thin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id, where no row has one any single row.

    Rows are numbered first, so rows without a doc_id and repeated rows are thinned like all others.
    """
    row = next(n for n in ("row", *(f"row_{i}" for i in range(len(docs.columns)))) if n not in docs.columns)
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = near_copies(numbered.select(F.col(row).alias("doc_id"), "text"), NEAR_PERCENT).select(F.col("doc_id").alias("_row"), "component_id")
    placed = stored(groups.join(numbered.select(F.col(row).alias("_row"), F.col("doc_id").alias("_id")), "_row"), "groups")
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("first"))
    dropped = placed.join(first, "component_id").filter(F.col("first._row") != F.col("_row")).select(F.col("_row").alias(row))
    return numbered.join(stored(dropped, "near-copies"), row, "left_anti").select(*docs.columns)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    small_batches(spark)
    return mask_pii(docs)


def blend(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 1024 tokens."""
    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", classify), ("near-dedup", thin), ("pii", mask), ("source mixing", blend), ("best-fit packing", pack),
]
ORACLE_SQL = None  # models, tokenizers and hashes of sets have no SQL; tests compare every stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
