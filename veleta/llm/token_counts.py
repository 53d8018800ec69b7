"""Token counts through a digest cache (operator 3)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veleta.llm.common import BLANK, slices, text_of
from veleta.llm.tokenization import count_tokens
from veleta.session import scratch_dir

CACHE_SCHEMA = "tokenizer STRING, content STRING, n_tokens LONG"
LIMIT = 2048


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def content_digest():
    """Digest of the text with white-space runs as single blanks, which the tokenizer drops in any case."""
    return F.sha2(F.regexp_replace(text_of(), BLANK, " "), 256)


def _first_of_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first row of each digest in this task, so that a text of very many copies is sent once per task."""
    seen: set[str] = set()
    for batch in batches:
        fresh = batch[~batch["content"].duplicated() & ~batch["content"].isin(seen)]
        seen.update(fresh["content"])
        yield fresh


def _encode_misses(path: str, version: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[str] = set()
        for batch in slices(batches):
            fresh = batch[~batch["content"].duplicated() & ~batch["content"].isin(done)]
            done.update(fresh["content"])
            yield pd.DataFrame(
                {"tokenizer": version, "content": fresh["content"], "n_tokens": count_tokens(fresh["text"].tolist(), path)}
            )

    return run


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """Stored counts, one per tokenizer and content; a cache that does not exist yet is empty.

    Two jobs that fill one cache at a time may both append a digest; it still counts once here.
    """
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)
    return rows.groupBy("tokenizer", "content").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(documents: DataFrame, tokenizer_path: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Tokens of every whole text.

    ``cache`` is a Parquet folder that executors share; without one, a new cache is made below
    ``spark.checkpoint.dir``. Known digests are joined to their counts, the texts of unknown ones
    are encoded once each, and their counts are appended to the cache.

    Returns doc_id, n_bytes, n_tokens and over_limit per input row. A null text counts as an empty
    one (0 tokens); null and repeated doc_ids keep their rows; an empty table gives no rows.
    """
    spark = documents.sparkSession
    cache = cache or scratch_dir(spark, "token-cache")
    version = tokenizer_digest(tokenizer_path)
    rows = documents.select("doc_id", text_of().alias("text")).withColumn("content", content_digest())
    known = read_cache(spark, cache).filter(F.col("tokenizer") == version)
    first = rows.select("content", "text").mapInPandas(_first_of_each, "content STRING, text STRING")
    missing = first.join(known.select("content"), "content", "left_anti").repartition("content")
    missing.mapInPandas(_encode_misses(tokenizer_path, version), CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).filter(F.col("tokenizer") == version).select("content", "n_tokens")
    narrow = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
    return narrow.join(counts, "content", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
