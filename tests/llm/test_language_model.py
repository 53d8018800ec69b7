"""The n-gram model against a plain version in dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import SCHEMA
from veleta.llm.language_model import Model, fit_language_model, modified_discounts, score_documents

NAMES = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["\n"]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def plain(rows):
    train = [words(r[1]) for r in rows if not held(r[0])]
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for ws in train for p in zip(["<s>", *ws], ws))
    before, after = Counter(b for _, b in pairs), defaultdict(list)
    for (a, _), k in pairs.items():
        after[a].append(k)

    def cut(counts):
        return (0.0, *modified_discounts([sum(x == k for x in counts) for k in (1, 2, 3, 4)]))

    d2, d1 = cut(pairs.values()), cut(before.values())
    total = len(pairs)
    uniform = sum(d1[min(k, 3)] for k in before.values()) / max(total, 1) if total else 1.0

    def low(w):
        k = before[w]
        return (k - d1[min(k, 3)]) / max(total, 1) + uniform / (v + 1)

    def p(a, w):
        if not after[a]:
            return low(w)
        k = pairs[a, w]
        return (k - d2[min(k, 3)]) / sum(after[a]) + sum(d2[min(x, 3)] for x in after[a]) / sum(after[a]) * low(w)

    out = []
    for r in rows:
        ws = words(r[1])
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        out.append((r[0], held(r[0]), len(ws), sum(c[w] > 0 for w in ws), n, base, sum(math.log10(p(a, w)) for a, w in zip(["<s>", *ws], ws))))
    return out


def same(df, rows):
    got = sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=repr)
    want = sorted(plain(rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("bucket_tokens,shard,flush", [(2_000_000, 1_000_000, 1_000_000), (500, 60, 700)])
def test_equals_plain_version(spark, corpus, docs, monkeypatch, tmp_path, bucket_tokens, shard, flush):
    from veleta.llm import language_model as lm

    monkeypatch.setattr(lm, "FLUSH_TOKENS", flush)
    model = fit_language_model(docs, str(tmp_path / "model"), bucket_tokens, shard)
    same(score_documents(docs, model), corpus)
    same(score_documents(docs, Model.load(model.folder)), corpus)


def test_frequent_pairs_and_clashing_columns(spark, clashing):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("aabcdA") for _ in range(rng.choice([0, 5, 90]))), "en", None, None) for i in range(60)]
    rows += [(100 + i, "a b a b", "en", None, None) for i in range(30)] + [(None, None, None, None, None), (None, "a", None, None, None)]
    from pyspark.sql import functions as F

    table = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("hash", "n", "held_out", "score", "bucket", "rank")})
    same(score_documents(table, fit_language_model(table, bucket_tokens=40)), rows)


def test_nothing_learned(spark, empty):
    model = fit_language_model(empty)
    assert score_documents(empty, model).collect() == []
    only_held = [(i, "some words", "en", None, None) for i in range(60) if held(i)]
    same(score_documents(spark.createDataFrame(only_held, SCHEMA), fit_language_model(spark.createDataFrame(only_held, SCHEMA))), only_held)


def test_probabilities_sum_to_one(spark, docs):
    """Over all known words and the unseen one, after a frequent, a rare and an unknown word."""
    model = fit_language_model(docs)
    vocabulary = sorted({w for r in docs.collect() if not held(r["doc_id"]) for w in words(r["text"])} - {"\n"})
    for before in ("the", "word125", "neverseen"):
        alone = model.score([before])["score"][0]
        ended = 10 ** (alone - first(model, before))
        after = [10 ** (s - first(model, before) - e) for s, e in zip(model.score([f"{before} {w}" for w in vocabulary])["score"], ends(model, vocabulary))]
        unseen = 10 ** (model.score([f"{before} zzzunseen"])["score"][0] - first(model, before) - ends(model, ["zzzunseen"])[0])
        assert ended + sum(after) + unseen == pytest.approx(1, abs=1e-9)


def ends(model, vocabulary):
    """log10 of the end after each word: what the second repetition of a text's last word adds."""
    out = []
    for w in vocabulary:
        twice = model.score([f"{w} {w} {w}", f"{w} {w}"])["score"]
        repeat = twice[0] - twice[1]  # w after w
        out.append(model.score([f"{w} {w}"])["score"][0] - first(model, w) - repeat)
    return out


def first(model, word):
    """log10 of a word at the beginning of a text."""
    one, two, three = model.score([word, f"{word} {word}", f"{word} {word} {word}"])["score"]
    # one = start + end; two - one = repeat, so start is what remains of a text that never ends
    from veleta.llm import language_model as lm
    import numpy as np

    hashes, _ = lm._hashed([word])
    rank = model.ranks(np.sort(hashes[:1]))
    total, weight, before = (model.contexts(rank) if rank[0] >= 0 else (np.zeros(1), np.ones(1), np.zeros(1, np.int64)))
    low = model.uniform / (model.words + 1) + lm._discounted(before, model.word_discounts)[0] / model.pairs
    seen = model.pair_counts(np.array([model.start]), rank) if rank[0] >= 0 else np.zeros(1, np.int64)
    return math.log10(lm._discounted(seen, model.pair_discounts)[0] / model.start_total + model.start_weight * low)
