"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 1)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veleta.llm.common import slices, text_of
from veleta.llm.quality_rules import STOP_WORDS

SAMPLE_ROWS = 20_000  # labelled rows that the trees are fitted on, at most
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
L2 = 1.0
LEAST_ROWS = 20

FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "distinct_words", "top_word", "adjacent_repeats",
    "distinct_pairs", "upper", "digits", "symbols", "exclamations", "pipes", "punctuation", "other_bytes", "byte_entropy",
    "log_lines", "repeated_lines", "line_words", "stop_words", "sentence_ends", "blank_bytes",
)
_STOP = frozenset(w.encode() for words in STOP_WORDS.values() for w in words)
_ENDS = (b".", b"!", b"?", b".\"", b":")


def statistics(text: str) -> list[float]:
    """Statistics of a whole text; those of an empty one are all 0."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    size = len(data)
    shares = counts[counts > 0] / size
    words = data.lower().split()
    n = len(words)
    per_word = max(n, 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    word_counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = counts[65:91].sum() + counts[97:123].sum()
    return [
        math.log1p(size), math.log1p(n), float(lengths.mean()) if n else 0.0, float(lengths.std()) if n else 0.0,
        len(word_counts) / per_word, max(word_counts.values(), default=0) / per_word,
        sum(map(bytes.__eq__, words, words[1:])) / per_word,
        len(set(zip(words, words[1:]))) / max(n - 1, 1),
        counts[65:91].sum() / max(letters, 1), counts[48:58].sum() / size,
        counts[[35, 36, 37, 38, 42, 60, 62, 64, 94, 95, 126]].sum() / per_word, counts[33] / per_word, counts[124] / per_word,
        counts[[44, 46, 58, 59, 63]].sum() / per_word, counts[128:].sum() / size, float(-(shares * np.log2(shares)).sum()),
        math.log1p(len(lines)), 1 - len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1),
        sum(word_counts[w] for w in _STOP if w in word_counts) / per_word,
        sum(c for w, c in word_counts.items() if w.endswith(_ENDS)) / per_word,
        counts[[9, 10, 13, 32]].sum() / size,
    ]


def _matrix(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


def _with_statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in slices(batches):
        yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "x": list(_matrix(batch["text"]))})


@dataclass(frozen=True)
class Trees:
    """Complete binary trees as arrays: node i of a tree has the children 2i + 1 and 2i + 2; rows go right above the cut."""

    bias: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row, all trees at once."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        for _ in range(self.depth):
            right = x[rows, self.feature[trees, node]] > self.cut[trees, node]
            node = 2 * node + 1 + right
        total = self.bias + self.leaf[trees, node - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosting on the logistic loss; every split is chosen on histograms of gradient and curvature per bin."""
    n, columns = x.shape if len(x) else (0, len(FEATURES))
    inner, leaves = 2**depth - 1, 2**depth
    prior = (y.sum() + 1) / (n + 2) if n else 0.5
    bias = math.log(prior / (1 - prior))
    feature, cut, leaf = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if n == 0 or y.min() == y.max():
        return Trees(bias, feature, cut, leaf, depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(columns)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(columns)])
    total = np.full(n, bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, curvature = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)  # within its level
        for level in range(depth):
            width = 2**level
            best_gain, best = np.full(width, 1e-9), [(0, np.inf, bins)] * width
            for j in range(columns):
                if not len(edges[j]):
                    continue
                slot = node * bins + binned[j]
                g, h, c = (np.bincount(slot, weights=w, minlength=width * bins).reshape(width, bins).cumsum(axis=1) for w in (gradient, curvature, None))
                gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g**2 / (h + L2) + (gt - g) ** 2 / (ht - h + L2) - gt**2 / (ht + L2)
                gain[(c < LEAST_ROWS) | (ct - c < LEAST_ROWS)] = 0
                gain[:, len(edges[j]):] = 0
                at = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(width), at] > best_gain):
                    best_gain[k], best[k] = gain[k, at[k]], (j, edges[j][at[k]], at[k])
            chosen = np.array([b[0] for b in best])
            split = np.array([b[2] for b in best])
            first = width - 1
            feature[t, first : first + width], cut[t, first : first + width] = chosen, [b[1] for b in best]
            node = 2 * node + (binned[chosen[node], np.arange(n)] > split[node])
        g = np.bincount(node, weights=gradient, minlength=leaves)
        h = np.bincount(node, weights=curvature, minlength=leaves)
        leaf[t] = -rate * g / (h + L2)
        total += leaf[t][node]
    return Trees(bias, feature, cut, leaf, depth)


def held_out() -> Column:
    """Rows that no label is learned from: crc32 of the doc_id's text leaves 1 when divided by 3. A null id is not one."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit_quality(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on at most ``sample_rows`` labelled rows that are not held out, chosen by a hash of their ids.

    Labels other than 0 and 1, and rows with null ids, teach nothing. With no or one label left, every score is the
    smoothed share of label 1.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = documents.select("doc_id", text_of().alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").mapInPandas(_with_statistics, "doc_id LONG, label INT, x ARRAY<DOUBLE>")
    rows = rows.groupBy("doc_id", "label").agg(F.min("x").alias("x")).orderBy("doc_id").toPandas()
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), len(FEATURES))
    return fit_trees(x, rows["label"].to_numpy(dtype=np.float64))


def score_of(model: Trees) -> Column:
    """Score of the text column; only texts travel to Python."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [model.score(_matrix(batch.iloc[i : i + 256])) for i in range(0, len(batch), 256)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return run(text_of())


def score_quality(documents: DataFrame, model: Trees) -> DataFrame:
    """doc_id, held_out, score and predicted per input row; a null text is scored as an empty one."""
    scored = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), score_of(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_quality(documents: DataFrame, model: Trees) -> DataFrame:
    """The documents that the model does not reject, with their columns as they came."""
    return documents.filter(score_of(model) >= 0.5)


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels and score every document: doc_id, held_out, score and predicted per input row.

    Null and repeated doc_ids keep their rows; an empty table gives no rows.
    """
    return score_quality(documents, fit_quality(documents, labels))
