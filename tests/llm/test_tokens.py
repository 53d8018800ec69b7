import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import rows_of
from veleta.llm import packing, token_counts
from veleta.llm.tokenization import byte_ranks, encode_ids

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def counted(corpus):
    t = Tokenizer.from_file(WORD)
    out = []
    for doc_id, text, *_ in corpus:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        out.append((doc_id, len((text or "").encode()), n, n > 2048))
    return sorted(out, key=repr)


def test_counts_equal_the_library(docs, corpus):
    assert rows_of(token_counts.token_counts(docs, WORD), "doc_id", "n_bytes", "n_tokens", "over_limit") == counted(corpus)


def test_clashing_columns_and_empty_table(clashing, empty, corpus):
    assert rows_of(token_counts.token_counts(clashing, WORD), "doc_id", "n_bytes", "n_tokens", "over_limit") == counted(corpus)
    assert token_counts.token_counts(empty, WORD).count() == 0
    assert packing.pack_documents(empty, BYTE).count() == 0


def test_cache_takes_in_misses_only(spark, docs, corpus, tmp_path):
    cache = str(tmp_path / "cache")
    half = docs.filter("doc_id < 60")
    token_counts.token_counts(half, WORD, cache).count()
    before = spark.read.parquet(cache).count()
    assert before == len({" ".join((t or "").split(" ")) for i, t, *_ in corpus if i is not None and i < 60})
    assert rows_of(token_counts.token_counts(docs, WORD, cache), "doc_id", "n_bytes", "n_tokens", "over_limit") == counted(corpus)
    after = spark.read.parquet(cache)
    assert after.count() == after.select("content").distinct().count() > before
    token_counts.token_counts(docs, WORD, cache).count()
    assert spark.read.parquet(cache).count() == after.count()


@pytest.mark.parametrize("text", [
    "", " ", "\n", "a  b", "a \n b", "a\n\nb", "\n\na", "a b  c", "x  y\n  z", "it's they'll  don't", "a\x1fb \x1f c", " lead", "trail ",
    "tab\tb\t\tc", "x<|endoftext|>", "a  <|endoftext|>  b", "é ü\r\n\r\n ñ", "​ x ﻿ y", "\x85 a \x85b", "12 345  6", "a　 b",
])
def test_ids_equal_the_library(text):
    want = Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids
    assert encode_ids([text], BYTE)[0] == struct.pack(f"<{len(want)}I", *want)


def test_ids_equal_the_library_for_every_character():
    library = Tokenizer.from_file(BYTE)
    points = [*range(0xD800), *range(0xE000, 0x33000), *range(0xE0000, 0xE0200)]
    for start in range(0, len(points), 10_000):
        texts = [f"a{c}b{c}1 {c}x 1{c} .{c}.  {c} \n{c}" for c in map(chr, points[start : start + 10_000])]
        want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        assert encode_ids(texts, BYTE) == want


def test_long_runs_and_other_vocabularies():
    for path, texts in [(BYTE, ["a" * 200_000, " " * 200_000 + "x", "^" * 100_000, "é \n" * 50_000]), (WORD, ["Two  words", ""])]:
        library = Tokenizer.from_file(path)
        want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert encode_ids(texts, path) == want
    assert byte_ranks(WORD) is None


def test_repeated_rows_spread_over_leaves(spark):
    rows = [(None, 5, 0, 0, 512, 0)] * 2000
    pieces = spark.createDataFrame(rows, "doc_id LONG, row_key LONG, piece INT, start LONG, length LONG, ids_crc32 LONG").repartition(3)
    out = packing.pack(pieces, leaf_items=200, fan_in=4).collect()
    assert len(out) == 2000 and len({r.sequence_id for r in out}) == 1000
    assert len({r.sequence_id >> 22 for r in out}) >= 10  # bins that were full in their leaves


def test_pack_round_trip(clashing, corpus):
    t = Tokenizer.from_file(BYTE)
    want = []
    for doc_id, text, *_ in corpus:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        first, start, piece = len(ids) % 1024 or 1024, 0, 0
        while start < len(ids):
            n = first if piece == 0 else 1024
            want.append((doc_id, piece, start, n, zlib.crc32(struct.pack(f"<{n}I", *ids[start : start + n]))))
            start, piece = start + n, piece + 1
    out = packing.pack_documents(clashing, BYTE)
    assert rows_of(out, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in out.collect():
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(bins) <= 1.02 * -(-sum(w[3] for w in want) // 1024) + 1


def test_tree_of_small_leaves_packs_as_one_task(spark):
    rows = [(i, i, 0, 0, 1 + (i * 7919) % 1000, 0) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id LONG, row_key LONG, piece INT, start LONG, length LONG, ids_crc32 LONG")
    out = packing.pack(pieces, leaf_items=100, fan_in=4)
    used = Counter()
    for r in out.collect():
        used[r.sequence_id] += r.length
    assert sum(used.values()) == sum(r[4] for r in rows) and max(used.values()) <= 1024 and out.count() == 3000
    whole = max(packing.best_fit([r[4] for r in rows], 1024)) + 1
    assert len(used) <= 1.08 * whole  # leaves of 100 items


def test_best_fit_against_a_plain_search():
    lengths = [(i * 37) % 90 + 5 for i in range(300)]
    left, want = [], {}
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        fits = [b for b in range(len(left)) if left[b] >= lengths[i]]
        b = min(fits, key=lambda b: left[b]) if fits else len(left)
        left[b:] = [100] if b == len(left) else left[b:]
        left[b] -= lengths[i]
        want[i] = b
    got = packing.best_fit(lengths, 100)
    assert max(got) + 1 == len(left)
