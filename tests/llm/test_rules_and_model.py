import re
import zlib
from collections import Counter

import numpy as np

from tests.llm.conftest import rows_of
from veleta.llm import quality_model as M
from veleta.llm.quality_rules import RULES, STOP_WORDS, quality_rules

WORD, SYMBOL = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[#*$%&|<>]")


def judged(corpus):
    stop = {f for words in STOP_WORDS.values() for w in words for f in (w, w.capitalize(), w + ".", w + ",")}
    out = []
    for doc_id, text, *_ in corpus:
        text = text or ""
        w = WORD.findall(text)
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {p for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        m = {
            "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(SYMBOL.findall(text)), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(covered), "n_lines": len(lines), "n_stop_words": sum(x in stop for x in w),
        }
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        kept = not failed and all(
            m[r.denominator] == 0 or ((r.low is None or m[r.numerator] >= r.low * m[r.denominator]) and (r.high is None or m[r.numerator] <= r.high * m[r.denominator]))
            for r in RULES)
        out.append((doc_id, m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"], failed, kept))
    return sorted(out, key=repr)


NAMES = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def test_rules_against_brute_force(clashing, corpus):
    assert rows_of(quality_rules(clashing), *NAMES) == judged(corpus)


def test_rules_on_junk(spark):
    rows = [(1, "x$$$ y### " * 60), (2, "so so so " * 100), (3, "line of the words here\n" * 80), (4, "supercalifragilisticexpiali " * 60), (5, "a b\n" * 3)]
    rows = [(i, t, None, None, None) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    assert rows_of(quality_rules(df), *NAMES) == judged(rows)
    assert not any(r.kept for r in quality_rules(df).collect())


def test_rules_on_an_empty_table(empty):
    assert quality_rules(empty).count() == 0


def test_trees_traverse_as_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, len(M.FEATURES)))
    y = ((x[:, 2] > 0.3) ^ (x[:, 5] > 0)).astype(float)
    model = M.fit_trees(x, y, trees=30)
    score = model.score(x)
    assert ((score >= 0.5) == y).mean() > 0.95 and score.min() >= 0 and score.max() <= 1
    for row in (0, 17, 500):
        total = model.bias
        for t in range(30):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + 1 + int(x[row, model.feature[t, node]] > model.cut[t, node])
            total += model.leaf[t, node - (2**model.depth - 1)]
        assert abs(1 / (1 + np.exp(-total)) - score[row]) < 1e-12


def test_held_out_accuracy_and_unused_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = {r.doc_id: r for r in M.quality_scores(docs, labels).collect()}
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    held = [(out[r.doc_id].predicted, r.quality) for r in labels.collect() if out[r.doc_id].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.9
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1, 1 - quality, quality) AS quality", "toxic")
    assert {r.doc_id: r.score for r in M.quality_scores(docs, turned).collect()} == {i: r.score for i, r in out.items()}


def test_model_edge_cases(spark, clashing, empty, corpus):
    none = spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")
    out = M.quality_scores(clashing, none).collect()
    assert len(out) == len(corpus) and {r.score for r in out} == {0.5}
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 7, 0), (4, 1, 0), (4, 1, 1)], "doc_id LONG, quality INT, toxic INT")
    assert len({r.score for r in M.quality_scores(clashing, odd).collect()}) == 1
    assert M.quality_scores(empty, odd).count() == 0
    kept = M.keep_quality(clashing, M.fit_quality(clashing, none))
    assert kept.columns == clashing.columns and kept.count() == len(corpus)
