"""Registered queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veleta.llm import collocations, mixing, near_dedup, prefix_trie, topk
from veleta.llm.common import table
from veleta.llm.language_model import language_scores
from veleta.llm.packing import pack_documents
from veleta.llm.pii import find_pii
from veleta.llm.quality_model import quality_scores
from veleta.llm.quality_rules import ORACLE_SQL as RULES_SQL
from veleta.llm.quality_rules import quality_rules
from veleta.llm.suffix_dedup import repeats_digest
from veleta.llm.token_counts import token_counts
from veleta.llm.warc import round_trip
from veleta.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]


def _documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _mixed(s: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_documents(s, d)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": lambda s, d: quality_scores(_documents(s, d), table(s, d, "labels")),
    "op2_suffix_dedup": lambda s, d: repeats_digest(_documents(s, d)),
    "op3_token_counts": lambda s, d: token_counts(_documents(s, d), public_tokenizers.path("word_bpe_49k.json")),
    "op4_warc": lambda s, d: round_trip(table(s, d, "pages"), scratch_dir(s, "warc")),
    "op5_best_fit_packing": lambda s, d: pack_documents(_documents(s, d), public_tokenizers.path("byte_bpe_50k.json")),
    "op6_exact_topk": lambda s, d: topk.top_k(table(s, d, "embeddings")),
    "op7_quality_rules": lambda s, d: quality_rules(_documents(s, d)),
    "op8_source_mixing": _mixed,
    "op9_pii": lambda s, d: find_pii(_documents(s, d)),
    "op10_near_dedup": lambda s, d: near_dedup.near_copies(_documents(s, d)),
    "op11_prefix_trie": lambda s, d: prefix_trie.prefix_trie(table(s, d, "conversations")),
    "op12_collocations": lambda s, d: collocations.collocations(_documents(s, d)),
    "op13_lm_scoring": lambda s, d: language_scores(_documents(s, d)),
}
ORACLES: dict[str, str] = {
    "op6_exact_topk": topk.ORACLE_SQL,
    "op7_quality_rules": RULES_SQL,
    "op8_source_mixing": mixing.ORACLE_SQL,
    "op10_near_dedup": near_dedup.ORACLE_SQL,
    "op11_prefix_trie": prefix_trie.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
}
