"""Phrases against plain counting of all n-grams."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, rows_of
from veleta.llm.collocations import PhraseFilter, collocations, phrase_counts

NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def grams(rows, longest):
    f = {}
    for _, text, lang, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for i in range(len(ws)):
                for k in range(1, longest + 1):
                    if i + k <= len(ws):
                        f.setdefault(lang or "und", Counter())[tuple(ws[i : i + k])] += 1
    return f


def brute(rows, least, longest=5, report=2000):
    out = []
    for lang, f in grams(rows, longest).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            if any(len(y) > len(p) and c >= a and any(y[i : i + len(p)] == p for i in range(len(y) - len(p) + 1)) for y, c in candidates.items()):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:report], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out, key=repr)


def texts(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        parts = [rng.choice(["the", "of", "a", "The", "é", "new york city", "in order to go", "x x", "rare%d" % rng.randrange(400)]) for _ in range(rng.choice([0, 4, 60]))]
        text = "".join(p + rng.choice([" ", " ", " ", ", ", "\t", ".\n", "\r", " \x0b"]) for p in parts)
        rows.append((i, text, rng.choice(["en", "de", None]), None, None))
    return rows + [(1, rows[3][1], "en", None, None)] * 20 + [(None, None, "en", None, None), (5, "", "fr", None, None), (6, " , \n", None, None, None)]


@pytest.mark.parametrize("least,group", [(12, 400_000), (5, 3), (2, 40)])
def test_equals_plain_counting(spark, least, group):
    rows = texts(least)
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert rows_of(collocations(table, least, group_suffixes=group), *NAMES) == brute(rows, least)


def test_counts_of_shared_corpus(spark, corpus, docs, clashing):
    want = {(lang, " ".join(p), c) for lang, f in grams(corpus, 5).items() for p, c in f.items() if c >= 100}
    assert {tuple(r) for r in phrase_counts(docs, group_suffixes=50)[0].collect()} == want
    assert rows_of(collocations(clashing), *NAMES) == brute(corpus, 100)


def test_empty_table_and_report(spark, empty):
    assert collocations(empty).collect() == []
    rows = texts(1)
    table = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(collocations(table, 5, report=4), *NAMES) == brute(rows, 5, report=4)


def test_scores_beyond_64_bits_are_exact(spark):
    big = spark.range(1).select(F.expr(
        "(cast(1000 * cast(9000000000000 as decimal(16, 0)) as decimal(19, 0)) * cast(123456789012345678 as decimal(19, 0))) div (cast(9000000000001 as decimal(19, 0)) * cast(9000000000007 as decimal(19, 0)))"))
    assert big.first()[0] == 1000 * 9000000000000 * 123456789012345678 // (9000000000001 * 9000000000007)


def test_filter_loses_no_phrase(spark):
    phrases = [f"w{i} é{i % 7}" for i in range(5000)]
    table = spark.createDataFrame([("en", p.encode()) for p in phrases], "lang STRING, phrase BINARY")
    kept = PhraseFilter.of(table, 5000)
    assert kept.holds(b"en", [p.encode() for p in phrases]).all()
    assert np.mean(kept.holds(b"en", [f"v{i}".encode() for i in range(5000)])) < 0.05
