"""Interpolated modified Kneser-Ney model of order two in sorted hash arrays (operator 13).

Words are 64-bit hashes; a word's rank is its place among the sorted hashes of the training text. Counting is done in
Spark: words by hash, then pairs of ranks by bucket. The arrays are written as files into the folder that all executors share,
and workers map them into memory, so a worker reads only the pages that its texts ask for.

Buckets of pairs hold about equally many tokens: a first word takes as much room as it has occurrences, and its followers
are spread over that room by rank, so the followers of a very frequent word lie in many buckets.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veleta.llm.common import slices, stored, text_of
from veleta.session import scratch_dir

HELD_OUT = (5, 1)  # documents whose crc32(doc_id) leaves 1 when divided by 5 are not learned from
END = b"\n"  # no word holds it
SHARD_WORDS = 1_000_000  # distinct words in a file
BUCKET_TOKENS = 2_000_000  # tokens whose pairs are counted in one task and kept in one file
FLUSH_TOKENS = 1_000_000  # tokens that a task counts before it hands on its counts
OPEN_FILES = 4_096


def held_out(doc_id: Column) -> Column:
    """Rows without an id are learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT[0] == HELD_OUT[1], F.lit(False))


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, one after the other, and the number of each text's tokens."""
    words, lengths = [], []
    for text in texts:
        own = text.encode("utf-8").lower().split()  # bytes: only A-Z change, only ASCII white space splits
        own.append(END)
        words += own
        lengths.append(len(own))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    return hashes.view(np.int64), np.array(lengths, dtype=np.int64)


# ---- files -------------------------------------------------------------------------------------------------------

_open: OrderedDict[str, np.ndarray] = OrderedDict()


def _load(path: str) -> np.ndarray:
    """A mapped array; the least recently used ones are closed."""
    if path in _open:
        _open.move_to_end(path)
    else:
        _open[path] = np.load(path, mmap_mode="r") if os.path.getsize(path) > 128 else np.load(path)
        if len(_open) > OPEN_FILES:
            _open.popitem(last=False)
    return _open[path]


def _save(path: str, values: np.ndarray) -> None:
    """Written beside and renamed, so that a repeated task leaves one whole file."""
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "wb") as out:
        np.save(out, values)
    os.replace(beside, path)


def mounted_folder(spark: SparkSession) -> str:
    """A new folder that executors reach as files."""
    path = scratch_dir(spark, "language-model")
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"workers map the model into memory: give a folder that all executors mount, not {parsed.scheme}://")
    path = unquote(parsed.path)
    os.makedirs(path, exist_ok=True)
    return path


# ---- the model ---------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Figures of a fitted model; its arrays lie in ``folder``."""

    folder: str
    tokens: int = 0
    words: int = 0
    documents: int = 0
    shards: int = 1
    shard_words: int = SHARD_WORDS
    bucket_tokens: int = BUCKET_TOKENS
    first_rank: list[int] = field(default_factory=list)  # of each shard of words
    first_token: list[int] = field(default_factory=list)
    pair_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    word_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    pairs: int = 0  # distinct pairs
    uniform: float = 1.0  # weight that the lowest order gives to all words alike
    start_total: int = 0
    start_weight: float = 1.0

    def save(self) -> None:
        with open(os.path.join(self.folder, "model.json"), "w") as out:
            json.dump(asdict(self), out)

    @staticmethod
    def load(folder: str) -> Model:
        with open(os.path.join(folder, "model.json")) as file:
            return Model(**json.load(file))

    def path(self, kind: str, number: int) -> str:
        return os.path.join(self.folder, f"{kind}-{number}.npy")

    @property
    def start(self) -> int:
        """Rank of the mark before a text's first word."""
        return self.words

    def shard_of(self, hashes: np.ndarray) -> np.ndarray:
        return np.minimum(((hashes.astype(np.float64) / 2.0**64 + 0.5) * self.shards).astype(np.int64), self.shards - 1)

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks of sorted hashes; -1 for words that were not learned."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        if self.words:
            shard = self.shard_of(hashes)
            edges = np.flatnonzero(np.diff(shard, prepend=-1, append=self.shards))
            for a, b in zip(edges, edges[1:]):
                keys = _load(self.path("words", shard[a]))
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, hashes[a:b]), len(keys) - 1)
                    out[a:b] = np.where(keys[at] == hashes[a:b], at + self.first_rank[shard[a]], -1)
        return out

    def _by_shard(self, kind: str, ranks: np.ndarray) -> np.ndarray:
        """Values of an array that is kept beside the words."""
        out = np.zeros(len(ranks), dtype=np.int64)
        order = np.argsort(ranks, kind="stable")
        ordered = ranks[order]
        shard = np.searchsorted(self.first_rank, ordered, side="right") - 1
        edges = np.flatnonzero(np.diff(shard, prepend=-1, append=len(self.first_rank)))
        for a, b in zip(edges, edges[1:]):
            out[order[a:b]] = _load(self.path(kind, shard[a]))[ordered[a:b] - self.first_rank[shard[a]]]
        return out

    def counts(self, ranks: np.ndarray) -> np.ndarray:
        return self._by_shard("counts", ranks)

    def buckets(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each pair of ranks and its key there."""
        known = left < self.words
        before, room = np.full(len(left), self.tokens, dtype=np.int64), np.full(len(left), self.documents, dtype=np.int64)
        inner, back = np.unique(left[known], return_inverse=True)
        before[known], room[known] = self._by_shard("before", inner)[back], self.counts(inner)[back]
        share = np.minimum((room * (right / (self.words + 1))).astype(np.int64), room - 1)
        bucket = (before + share) // self.bucket_tokens
        distinct, back = np.unique(bucket, return_inverse=True)
        return bucket, (left - self._first_left(distinct)[back]) * (self.words + 1) + right

    def _first_left(self, buckets: np.ndarray) -> np.ndarray:
        """Smallest rank whose room reaches into each bucket."""
        out = np.full(len(buckets), self.start, dtype=np.int64)
        for i, token in enumerate((buckets * self.bucket_tokens).tolist()):
            if token < self.tokens:
                shard = int(np.searchsorted(self.first_token, token, side="right")) - 1
                out[i] = self.first_rank[shard] + np.searchsorted(_load(self.path("before", shard)), token, side="right") - 1
        return out

    def pair_counts(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Occurrences of each pair of ranks in the training text."""
        out = np.zeros(len(left), dtype=np.int64)
        if not len(left):
            return out
        bucket, key = self.buckets(left, right)
        order = np.lexsort((key, bucket))
        ordered, key = bucket[order], key[order]
        edges = np.flatnonzero(np.diff(ordered, prepend=-1, append=ordered[-1] + 1))
        for a, b in zip(edges, edges[1:]):
            name = self.path("pairs", ordered[a])
            if os.path.exists(name):
                keys = _load(name)
                at = np.minimum(np.searchsorted(keys, key[a:b]), len(keys) - 1)
                out[order[a:b]] = np.where(keys[at] == key[a:b], _load(self.path("pair-counts", ordered[a]))[at], 0)
        return out

    def contexts(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per rank: tokens that follow it, the weight of the lower order after it, and how many words precede it."""
        total, weight, before = np.zeros(len(ranks), np.int64), np.ones(len(ranks)), np.zeros(len(ranks), np.int64)
        order = np.argsort(ranks, kind="stable")
        ordered = ranks[order]
        file = ordered // self.shard_words
        edges = np.flatnonzero(np.diff(file, prepend=-1, append=(file[-1] + 1) if len(file) else 0))
        for a, b in zip(edges, edges[1:]):
            at, to = ordered[a:b] - file[a] * self.shard_words, order[a:b]
            total[to], weight[to] = _load(self.path("totals", file[a]))[at], _load(self.path("weights", file[a]))[at]
            before[to] = _load(self.path("preceding", file[a]))[at]
        return total, weight, before

    def score(self, texts: list[str]) -> pd.DataFrame:
        """n_tokens, n_known, base_score and score of each text."""
        hashes, lengths = _hashed(texts)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        distinct, word = np.unique(hashes, return_inverse=True)
        ranks = self.ranks(distinct)
        known = ranks >= 0
        counts, total, weight, before = (np.zeros(len(distinct), np.int64) for _ in range(4))
        weight = np.ones(len(distinct))
        counts[known] = self.counts(ranks[known])
        total[known], weight[known], before[known] = self.contexts(ranks[known])
        base = np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.words + 1)))
        lowest = self.uniform / (self.words + 1) + _discounted(before, self.word_discounts) / max(self.pairs, 1)
        # the word before each token; texts begin after the start mark
        left = np.empty_like(word)
        left[1:] = word[:-1]
        left[starts] = len(distinct)
        ranks, total = np.append(ranks, self.start if self.documents else -1), np.append(total, self.start_total)
        weight = np.append(weight, self.start_weight)
        codes, back = np.unique(left * (len(distinct) + 1) + word, return_inverse=True)
        lefts, rights = ranks[codes // (len(distinct) + 1)], ranks[codes % (len(distinct) + 1)]
        both = (lefts >= 0) & (rights >= 0)
        seen = np.zeros(len(codes), np.int64)
        seen[both] = self.pair_counts(lefts[both], rights[both])
        higher = _discounted(seen, self.pair_discounts)[back] / np.maximum(total[left], 1)
        p = higher + np.where(total[left] > 0, weight[left], 1.0) * lowest[word]
        return pd.DataFrame({
            "n_tokens": lengths, "n_known": np.add.reduceat((counts > 0)[word].astype(np.int64), starts),
            "base_score": np.add.reduceat(base[word], starts), "score": np.add.reduceat(np.log10(p), starts),
        })


def _discounted(counts: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return counts - np.array([0.0, *discounts])[np.minimum(counts, 3)]


def modified_discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts for counts of one, two and more from the numbers of n-grams seen once to four times.

    Where these numbers give none within (0, count], as on very small texts, 0.5, 1 and 1.5 are taken.
    """
    if min(n[:4]) > 0:
        y = n[0] / (n[0] + 2 * n[1])
        out = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
        if all(0 < d <= k for k, d in zip((1, 2, 3), out)):
            return out
    return 0.5, 1.0, 1.5


# ---- counting ----------------------------------------------------------------------------------------------------


def _flushed(frames: Iterator[pd.DataFrame], take) -> Iterator[list]:
    """Results of ``take`` per slice, in lists of about FLUSH_TOKENS tokens."""
    held, tokens = [], 0
    for frame in slices(frames):
        hashes, lengths = _hashed(frame["text"].tolist())
        held.append(take(hashes, lengths))
        tokens += len(hashes)
        if tokens >= FLUSH_TOKENS:
            yield held
            held, tokens = [], 0
    if held:
        yield held


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.array([], np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for held in _flushed(frames, lambda hashes, lengths: np.unique(hashes, return_counts=True)):
        keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        yield pd.DataFrame({"hash": keys, "n": counts})


def _write_words(model: Model):
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        frame = frame.sort_values("hash")
        counts = frame["n"].to_numpy(np.int64)
        _save(model.path("words", shard), frame["hash"].to_numpy(np.int64))
        _save(model.path("counts", shard), counts)
        return pd.DataFrame({"shard": [shard], "words": [len(counts)], "tokens": [int(counts.sum())]})

    return run


def _write_before(model: Model):
    """Tokens before each word of a shard, known once the shards before it are counted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["shard"].tolist():
                counts = np.load(model.path("counts", shard))
                _save(model.path("before", shard), model.first_token[shard] + np.cumsum(counts) - counts)
            yield frame

    return run


def _count_pairs(model: Model):
    """Pairs of each flush by bucket: sorted keys as differences, and counts, compressed."""

    def ranked(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, back = np.unique(hashes, return_inverse=True)
        right = model.ranks(distinct)[back]
        left = np.empty_like(right)
        left[1:] = right[:-1]
        left[np.cumsum(lengths) - lengths] = model.start
        return left, right

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for held in _flushed(frames, ranked):
            bucket, key = model.buckets(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
            order = np.lexsort((key, bucket))
            bucket, key = bucket[order], key[order]
            fresh = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(key, prepend=-1) != 0))
            counts, bucket, key = np.diff(fresh, append=len(key)), bucket[fresh], key[fresh]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=bucket[-1] + 1))
            rows = [(int(bucket[a]), pack(np.diff(key[a:b], prepend=0).tobytes()), pack(counts[a:b].astype(np.uint32).tobytes())) for a, b in zip(edges, edges[1:])]
            yield pd.DataFrame(rows, columns=["bucket", "keys", "counts"])

    return run


CONTRIBUTION = "rank LONG, total LONG, once LONG, twice LONG, more LONG, preceding LONG"


def _merge_pairs(model: Model):
    """One bucket's counts to files. Returns what its pairs add to the figures of their words.

    Ranks below zero carry the numbers of pairs seen once to four times.
    """

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        bucket, unpack = int(key[0]), zstandard.ZstdDecompressor().decompress
        keys = np.concatenate([np.cumsum(np.frombuffer(unpack(k), np.int64)) for k in frame["keys"]])
        counts = np.concatenate([np.frombuffer(unpack(c), np.uint32) for c in frame["counts"]]).astype(np.int64)
        keys, counts = _summed(keys, counts)
        _save(model.path("pairs", bucket), keys)
        _save(model.path("pair-counts", bucket), counts if counts.max() >= 2**32 else counts.astype(np.uint32))
        left = keys // (model.words + 1) + model._first_left(np.array([bucket]))[0]
        first = np.flatnonzero(np.diff(left, prepend=-1))
        sums = [np.add.reduceat(x.astype(np.int64), first) for x in (counts, counts == 1, counts == 2, counts > 2)]
        right, preceding = np.unique(keys % (model.words + 1), return_counts=True)
        zero = np.zeros(len(right), np.int64)
        marks = np.arange(-1, -5, -1)
        of_counts = np.array([(counts == k).sum() for k in (1, 2, 3, 4)])
        columns = [
            np.concatenate([left[first], right, marks]), np.concatenate([sums[0], zero, of_counts]),
            *(np.concatenate([s, zero, zero[:4] if len(zero) >= 4 else np.zeros(4, np.int64)]) for s in sums[1:]),
            np.concatenate([np.zeros(len(first), np.int64), preceding, np.zeros(4, np.int64)]),
        ]
        return pd.DataFrame(dict(zip(("rank", "total", "once", "twice", "more", "preceding"), columns)))

    return run


def _write_contexts(model: Model):
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        file = int(key[0])
        at = (frame["rank"] - file * model.shard_words).to_numpy()
        size = min(model.shard_words, model.words - file * model.shard_words)
        total, weight, preceding = np.zeros(size, np.int64), np.ones(size), np.zeros(size, np.int64)
        total[at], preceding[at] = frame["total"], frame["preceding"]
        d1, d2, d3 = model.pair_discounts
        weight[at] = (d1 * frame["once"] + d2 * frame["twice"] + d3 * frame["more"]) / np.maximum(frame["total"], 1)
        _save(model.path("totals", file), total)
        _save(model.path("weights", file), weight)
        _save(model.path("preceding", file), preceding)
        return pd.DataFrame({
            **{f"n{k}": [int((preceding == k).sum())] for k in (1, 2, 3, 4)}, "n_more": [int((preceding > 2).sum())], "pairs": [int(preceding.sum())],
        })

    return run


def fit_language_model(
    documents: DataFrame, folder: str | None = None, bucket_tokens: int = BUCKET_TOKENS, shard_words: int = SHARD_WORDS,
) -> Model:
    """Count the training documents and write the model's arrays.

    Null texts are empty ones: their only token is the end. Without training documents every word is as likely as any.
    """
    spark = documents.sparkSession
    model = Model(folder or mounted_folder(spark), shard_words=shard_words, bucket_tokens=bucket_tokens)
    os.makedirs(model.folder, exist_ok=True)
    training = documents.select(F.col("doc_id").alias("doc_id"), text_of().alias("text")).filter(~held_out(F.col("doc_id"))).select("text")
    words = stored(training.mapInPandas(_count_words, "hash LONG, n LONG").groupBy("hash").agg(F.sum("n").alias("n")), "words")
    model.words, model.tokens = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not model.words:
        model.save()
        return model
    end = int(np.array([xxhash.xxh3_64_intdigest(END)], np.uint64).view(np.int64)[0])
    model.documents = words.filter(F.col("hash") == end).first()["n"]
    model.shards = -(-model.words // model.shard_words)
    place = F.floor((F.col("hash").cast("double") / F.lit(2.0**64) + 0.5) * model.shards).cast("long")
    shard = F.least(place, F.lit(model.shards - 1).cast("long"))
    sizes = words.groupBy(shard.alias("shard")).applyInPandas(_write_words(model), "shard LONG, words LONG, tokens LONG").collect()  # a row a file
    of_shard = {r["shard"]: (r["words"], r["tokens"]) for r in sizes}
    rank = token = 0
    for i in range(model.shards):
        model.first_rank.append(rank)
        model.first_token.append(token)
        if i in of_shard:
            rank, token = rank + of_shard[i][0], token + of_shard[i][1]
        else:
            for kind in ("words", "counts", "before"):
                _save(model.path(kind, i), np.array([], np.int64))
    files = spark.createDataFrame([(i,) for i in sorted(of_shard)], "shard LONG").repartition(len(of_shard), "shard")
    files.mapInPandas(_write_before(model), "shard LONG").count()

    counted = training.mapInPandas(_count_pairs(model), "bucket LONG, keys BINARY, counts BINARY")
    added = counted.groupBy("bucket").applyInPandas(_merge_pairs(model), CONTRIBUTION)
    sums = [F.sum(c).alias(c) for c in ("total", "once", "twice", "more", "preceding")]
    contexts = stored(added.groupBy("rank").agg(*sums), "contexts")
    few = {r["rank"]: r for r in contexts.filter((F.col("rank") < 0) | (F.col("rank") == model.start)).collect()}  # five rows
    model.pair_discounts = modified_discounts([few[-k]["total"] for k in (1, 2, 3, 4)])
    first = few[model.start]
    model.start_total = first["total"]
    model.start_weight = sum(d * first[c] for d, c in zip(model.pair_discounts, ("once", "twice", "more"))) / first["total"]
    inner = contexts.filter((F.col("rank") >= 0) & (F.col("rank") < model.start))
    names = ("n1", "n2", "n3", "n4", "n_more", "pairs")
    written = inner.groupBy(F.floor(F.col("rank") / model.shard_words).cast("long").alias("file")).applyInPandas(
        _write_contexts(model), ", ".join(f"{n} LONG" for n in names))
    n = written.agg(*[F.sum(c).alias(c) for c in names]).first()
    model.pairs = n["pairs"]
    model.word_discounts = modified_discounts([n[f"n{k}"] for k in (1, 2, 3, 4)])
    model.uniform = sum(d * n[c] for d, c in zip(model.word_discounts, ("n1", "n2", "n_more"))) / model.pairs
    model.save()
    return model


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is an empty one, whose only token is the end. Repeated rows are scored each; an empty table gives
    no rows; other columns are ignored. Words that were not learned share the probability of one unseen word.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            if len(frame):
                scores = model.score(frame["text"].tolist())
                scores.index = frame.index
                yield pd.concat([frame[["doc_id", "held_out"]], scores], axis=1).assign(train_tokens=model.tokens)

    rows = documents.select(F.col("doc_id").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_of().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    schema = f"doc_id {kind}, held_out BOOLEAN, n_tokens LONG, n_known LONG, base_score DOUBLE, score DOUBLE, train_tokens LONG"
    return rows.mapInPandas(run, schema).select(*names)


def language_scores(documents: DataFrame) -> DataFrame:
    """Fit on the training part and score every document."""
    return score_documents(documents, fit_language_model(documents))
