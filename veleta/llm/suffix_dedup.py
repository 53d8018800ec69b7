"""Removal of repeated passages by longest-previous-factor arrays over sparse suffixes (operator 2).

A byte is removed if a string of ``LENGTH`` bytes around it also starts in a document that comes earlier. Suffixes of a whole
corpus cannot be sorted in one place, and need not be: of every window of LENGTH bytes, the smallest hash of the
GRAM-byte strings in it depends on the window alone. Neighbouring windows with one smallest hash form a run, and equal
windows, wherever they stand, lie in runs of equal hash. So

1. documents are packed into batches of a few MB;
2. each batch sends its distinct run hashes, four bytes each, to buckets, which answer with a bit per hash: does another
   batch have it;
3. runs whose hash stands in several documents send their bytes, once per batch and content. A bucket sorts the suffixes of
   its runs; previous and next smaller positions in suffix order give each window's match in an earlier document, and a bit
   per window goes back;
4. batches cut the covered bytes out of their documents.

A batch sends a hash or content once, however many of its documents hold it, and answers go to batches, so a passage that a
third of all documents share costs a row per batch. Runs whose hash very many batches hold are cut into single windows,
dealt by their own bytes, since what stands around a common passage differs everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veleta.llm.common import stored, text_of

LENGTH = 50
GRAM = 28
SPAN = LENGTH - GRAM + 1  # grams in a window, and windows in a run of one gram
WIDTH = LENGTH + SPAN - 1  # bytes of the longest run
BATCH_BYTES = 4 << 20
PART_BYTES = 1 << 20  # bytes hashed at a time
BUCKET_BYTES = 16 << 20  # input bytes for each bucket
HOT_BATCHES = 256  # batches that hold a hash before its runs are cut into windows
LAST = np.iinfo(np.int64).max

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = [x | np.uint64(1) for x in _rng.integers(1, 1 << 63, 8, dtype=np.uint64)]
_WINDOW = _rng.integers(1, 1 << 63, LENGTH, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[6]
    x = (x ^ (x >> np.uint64(29))) * _ODD[7]
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every GRAM bytes in a row, from those of 1, 2, 4, 8 and 16 bytes."""
    h = {1: _BYTE[data]}
    for i, n in enumerate((1, 2, 4, 8)):
        h[2 * n] = h[n][:-n] * _ODD[i] + h[n][n:]
    count = len(data) - GRAM + 1
    return _mixed(h[16][:count] * _ODD[4] + h[8][16 : 16 + count] * _ODD[5] + h[4][24 : 24 + count])


def window_minima(h: np.ndarray) -> np.ndarray:
    """The smallest of every SPAN hashes in a row."""
    n = 1
    while 2 * n <= SPAN:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    rest = SPAN - n
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def _parts(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Documents of about PART_BYTES together."""
    first, size = 0, 0
    for i, n in enumerate(lengths):
        size += n
        if size >= PART_BYTES:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(lengths):
        yield first, len(lengths)


@dataclass
class Runs:
    """Runs of a batch: first window, number of windows, document and place of its hash among the batch's distinct keys."""

    start: np.ndarray
    count: np.ndarray
    doc: np.ndarray
    key: np.ndarray
    keys: np.ndarray  # distinct, sorted: bucket in the upper half, hash in the lower
    several: np.ndarray  # whether several documents of the batch have the key


def runs_of(data: np.ndarray, lengths: np.ndarray, buckets: int) -> Runs:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    starts, counts, docs, hashes = [], [], [], []
    for first, last in _parts(lengths):
        base, end = offsets[first], offsets[last]
        if end - base < LENGTH:
            continue
        minima = window_minima(gram_hashes(data[base:end]))
        inside = np.zeros(end - base + 1, dtype=np.int32)
        long = np.flatnonzero(lengths[first:last] >= LENGTH)
        at = offsets[first:last][long] - base
        inside[at] += 1
        np.subtract.at(inside, at + lengths[first:last][long] - LENGTH + 1, 1)
        window = np.flatnonzero(np.cumsum(inside)[: len(minima)] > 0)
        if not len(window):
            continue
        m = minima[window]
        new = np.concatenate([[True], (m[1:] != m[:-1]) | (window[1:] != window[:-1] + 1)])
        # one value may stay the smallest for longer than a window where it repeats; a run has SPAN windows at most
        place = np.flatnonzero(new)
        size = np.diff(np.append(place, len(m)))
        if size.max() > SPAN:
            more = -(-size // SPAN)
            inner = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            place, size = np.repeat(place, more) + inner * SPAN, np.minimum(SPAN, np.repeat(size, more) - inner * SPAN)
        starts.append(window[place] + base)
        counts.append(size)
        hashes.append(m[place])
    if not starts:
        none = np.zeros(0, dtype=np.int64)
        return Runs(none, none, none, none, none.astype(np.uint64), none.astype(bool))
    start, count, h = np.concatenate(starts), np.concatenate(counts), np.concatenate(hashes)
    doc = np.searchsorted(offsets, start, side="right") - 1
    wide = ((h % np.uint64(buckets)) << np.uint64(32)) | ((h // np.uint64(buckets)) & np.uint64(0xFFFFFFFF))
    keys, key = np.unique(wide, return_inverse=True)
    order = np.argsort(key, kind="stable")
    first = np.searchsorted(key[order], np.arange(len(keys)))
    several = np.minimum.reduceat(doc[order], first) < np.maximum.reduceat(doc[order], first)
    return Runs(start, count, doc, key, keys, several)


# --- batches ------------------------------------------------------------------------------------
BATCHES = "batch LONG, doc_ids ARRAY<LONG>, nulls ARRAY<BOOLEAN>, lengths ARRAY<LONG>, data BINARY"


def _pack(batch_bytes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number = TaskContext.get().partitionId(), 0
        ids, nulls, texts, size = [], [], [], 0

        def full() -> pd.DataFrame:
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pd.DataFrame({"batch": [(task << 32) + number], "doc_ids": [list(ids)], "nulls": [list(nulls)], "lengths": [[len(t) for t in texts]], "data": [data]})

        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                data = text.encode("utf-8", "surrogatepass")
                ids.append(int(doc_id) if doc_id else 0)
                nulls.append(not doc_id)
                texts.append(data)
                size += len(data)
                if size >= batch_bytes:
                    yield full()
                    ids, nulls, texts, size, number = [], [], [], 0, number + 1
        if texts:
            yield full()

    return run


def _opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, lengths and order numbers of a batch's documents; null ids come last."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.data) if len(row.data) else b"", dtype=np.uint8)
    order = np.where(np.asarray(row.nulls, dtype=bool), LAST, np.asarray(row.doc_ids, dtype=np.int64))
    return data, np.asarray(row.lengths, dtype=np.int64), order


def _by_bucket(buckets_of: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Stretches of equal values in a sorted array."""
    cuts = np.flatnonzero(buckets_of[1:] != buckets_of[:-1]) + 1
    for a, b in zip([0, *cuts], [*cuts, len(buckets_of)]):
        if b > a:
            yield int(buckets_of[a]), slice(a, b)


# --- step 2: which hashes do several batches have --------------------------------------------------
SENT = "bucket LONG, batch LONG, body BINARY"
ANSWERED = "batch LONG, bucket LONG, body BINARY"


def _send_keys(buckets: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                data, lengths, _ = _opened(row)
                keys = runs_of(data, lengths, buckets).keys
                parts = list(_by_bucket(keys >> np.uint64(32)))
                yield pd.DataFrame({"bucket": [b for b, _ in parts], "batch": row.batch, "body": [keys[s].astype("<u4").tobytes() for _, s in parts]})

    return run


def _answer_keys(hot_batches: int):
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        sent = [np.frombuffer(x, dtype="<u4") for x in frame["body"]]
        _, place, times = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        times = times[place]
        cuts = np.cumsum([len(x) for x in sent])[:-1]
        # a bit for "several batches", then a bit for "very many"
        bits = [np.packbits(np.stack([t > 1, t > hot_batches])).tobytes() for t in np.split(times, cuts)]
        return pd.DataFrame({"batch": frame["batch"], "bucket": int(key[0]), "body": bits})

    return run


# --- step 3: windows of shared runs -----------------------------------------------------------------
@dataclass
class Entries:
    """Distinct contents of a batch's shared runs, sorted by bucket; and the entry of every run or single window."""

    rows: np.ndarray  # key (8 bytes), length, bytes padded to WIDTH
    least: np.ndarray  # smallest order number of a document with the content
    start: np.ndarray
    count: np.ndarray
    doc: np.ndarray
    entry: np.ndarray


_ROW = 8 + 1 + WIDTH


def entries_of(data: np.ndarray, order: np.ndarray, runs: Runs, shared: np.ndarray, hot: np.ndarray, buckets: int) -> Entries:
    chosen = np.flatnonzero((shared | runs.several)[runs.key])
    cut = hot[runs.key[chosen]]
    plain, split = chosen[~cut], chosen[cut]
    inner = np.arange(runs.count[split].sum()) - np.repeat(np.cumsum(runs.count[split]) - runs.count[split], runs.count[split])
    single = np.repeat(runs.start[split], runs.count[split]) + inner
    start = np.concatenate([runs.start[plain], single])
    count = np.concatenate([runs.count[plain], np.ones(len(single), dtype=np.int64)])
    doc = np.concatenate([runs.doc[plain], np.repeat(runs.doc[split], runs.count[split])])
    size = count + LENGTH - 1
    rows = np.zeros((len(start), _ROW), dtype=np.uint8)
    at = np.arange(WIDTH)
    for a in range(0, len(start), 50_000):
        part = slice(a, a + 50_000)
        place = np.minimum(start[part, None] + at, len(data) - 1)
        rows[part, 9:] = np.where(at < size[part, None], data[place], 0)
    rows[:, 8] = size
    key = np.concatenate([runs.keys[runs.key[plain]], np.zeros(len(single), dtype=np.uint64)])
    if len(single):
        own = _mixed(rows[len(plain) :, 9 : 9 + LENGTH].astype(np.uint64) @ _WINDOW)
        key[len(plain) :] = ((own % np.uint64(buckets)) << np.uint64(32)) | (own & np.uint64(0xFFFFFFFF))
    rows[:, :8] = key.astype(">u8").view(np.uint8).reshape(-1, 8)
    distinct, entry, least = _distinct(rows, order[doc])
    return Entries(distinct, least, start, count, doc, entry)


def _distinct(rows: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in byte order, the place of each row among them, and the smallest order number of each."""
    if not len(rows):
        return rows, np.zeros(0, dtype=np.int64), order
    sort = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    ordered = rows[sort]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)])
    first = np.flatnonzero(new)
    place = np.empty(len(rows), dtype=np.int64)
    place[sort] = np.cumsum(new) - 1
    return ordered[first], place, np.minimum.reduceat(order[sort], first)


def _flags(answers, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both bits of step 2 for each key of a batch."""
    told = {a["bucket"]: a["body"] for a in answers} if answers is not None else {}
    shared, hot = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    for bucket, part in _by_bucket(keys >> np.uint64(32)):
        n = part.stop - part.start
        bits = np.unpackbits(np.frombuffer(told[bucket], dtype=np.uint8), count=2 * n).astype(bool)
        shared[part], hot[part] = bits[:n], bits[n:]
    return shared, hot


def _send_runs(buckets: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3)
        for frame in frames:
            for row in frame.itertuples(index=False):
                data, lengths, order = _opened(row)
                runs = runs_of(data, lengths, buckets)
                e = entries_of(data, order, runs, *_flags(row.answers, runs.keys), buckets)
                out = []
                for bucket, part in _by_bucket(_bucket(e.rows)):
                    rows = e.rows[part]
                    body = np.uint32(len(rows)).tobytes() + e.least[part].tobytes() + rows[:, :9].tobytes() + rows[:, 9:][np.arange(WIDTH) < rows[:, 8:9]].tobytes()
                    out.append((bucket, row.batch, pack.compress(body)))
                yield pd.DataFrame(out, columns=["bucket", "batch", "body"])

    return run


def _bucket(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows[:, :4]).view(">u4").ravel().astype(np.int64) if len(rows) else np.zeros(0, dtype=np.int64)


def _received(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(body, dtype=np.uint32, count=1)[0])
    least = np.frombuffer(body, dtype=np.int64, count=n, offset=4)
    rows = np.zeros((n, _ROW), dtype=np.uint8)
    rows[:, :9] = np.frombuffer(body, dtype=np.uint8, count=9 * n, offset=4 + 8 * n).reshape(n, 9)
    content = rows[:, 9:]
    content[np.arange(WIDTH) < rows[:, 8:9]] = np.frombuffer(body, dtype=np.uint8, offset=4 + 17 * n)
    return rows, least


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """Nearest place to the left with a smaller value, -1 if there is none.

    All values between a place and its pointer are at least its own; where the pointer's is too, its pointer is next.
    """
    pointer = np.arange(-1, len(values) - 1)
    open_ = np.flatnonzero((pointer >= 0) & (values[pointer] >= values))
    while len(open_):
        pointer[open_] = pointer[pointer[open_]]
        at = pointer[open_]
        open_ = open_[(at >= 0) & (values[at] >= values[open_])]
    return pointer


def earlier_matches(windows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor of each suffix has the windows' length.

    In suffix order, the best match among earlier documents is that with the previous or the next smaller order
    number. ``windows`` holds the first LENGTH bytes of each suffix, so a common prefix of that length is equality.
    """
    if not len(windows):
        return np.zeros(0, dtype=bool)
    suffixes = np.argsort(np.ascontiguousarray(windows).view(f"S{windows.shape[1]}").ravel(), kind="stable")
    ordered, number = windows[suffixes], order[suffixes]
    group = np.cumsum(np.concatenate([[False], (ordered[1:] != ordered[:-1]).any(axis=1)]))
    before = previous_smaller(number)
    after = len(number) - 1 - previous_smaller(number[::-1])[::-1]
    found = (before >= 0) & (group[np.maximum(before, 0)] == group)
    found |= (after < len(number)) & (group[np.minimum(after, len(number) - 1)] == group)
    out = np.empty(len(windows), dtype=bool)
    out[suffixes] = found
    return out


def _answer_runs(key, frame: pd.DataFrame) -> pd.DataFrame:
    """A bit per window of each entry sent: an earlier document, anywhere, has the same window."""
    received = [_received(x) for x in frame["body"]]
    rows, least = np.concatenate([r for r, _ in received]), np.concatenate([x for _, x in received])
    cuts = np.cumsum([len(x) for _, x in received])[:-1]
    del received
    distinct, place, first = _distinct(rows, least)
    count = distinct[:, 8].astype(np.int64) - LENGTH + 1
    keys = np.ascontiguousarray(distinct[:, :8]).view(">u8").ravel()
    # where all contents of a key are equal, their windows have no other matches
    alone = np.ones(len(keys), dtype=bool)
    same = keys[1:] == keys[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    masks = np.zeros(len(distinct), dtype=np.uint32)
    mixed = np.flatnonzero(~alone)
    # contents of one key stay together; some keys are sorted at a time
    edges = np.flatnonzero(np.concatenate([[True], keys[mixed[1:]] != keys[mixed[:-1]]])) if len(mixed) else mixed
    begins = np.unique(edges[np.searchsorted(edges, np.arange(0, len(mixed), 20_000), side="right") - 1]) if len(mixed) else edges
    for part in np.split(mixed, begins[1:]) if len(mixed) else []:
        owner = np.repeat(part, count[part])
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
        windows = distinct[owner[:, None], 9 + inner[:, None] + np.arange(LENGTH)]
        hit = earlier_matches(windows, first[owner])
        np.bitwise_or.at(masks, owner[hit], np.uint32(1) << inner[hit].astype(np.uint32))
    full = ((np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    out = masks[place] | np.where(least > first[place], full[place], np.uint32(0))
    pack = zstandard.ZstdCompressor(level=3)
    return pd.DataFrame({"batch": frame["batch"], "bucket": int(key[0]), "body": [pack.compress(x.astype("<u4").tobytes()) for x in np.split(out, cuts)]})


# --- step 4: cutting ------------------------------------------------------------------------------------
CUT = "doc_id LONG, is_null BOOLEAN, n_bytes LONG, spans ARRAY<LONG>, kept BINARY"


def _cut(buckets: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                data, lengths, order = _opened(row)
                runs = runs_of(data, lengths, buckets)
                e = entries_of(data, order, runs, *_flags(row.answers, runs.keys), buckets)
                told = {a["bucket"]: a["body"] for a in row.windows} if row.windows is not None else {}
                masks = np.zeros(len(e.rows), dtype=np.uint32)
                for bucket, part in _by_bucket(_bucket(e.rows)):
                    masks[part] = np.frombuffer(zstandard.ZstdDecompressor().decompress(told[bucket]), dtype="<u4")
                later = order[e.doc] > e.least[e.entry]
                change = np.zeros(len(data) + 1, dtype=np.int32)
                for j in range(SPAN):
                    hit = (j < e.count) & (later | ((masks[e.entry] >> np.uint32(j)) & np.uint32(1)).astype(bool))
                    at = e.start[hit] + j
                    change += np.bincount(at, minlength=len(change)).astype(np.int32)
                    change -= np.bincount(at + LENGTH, minlength=len(change)).astype(np.int32)
                covered = np.cumsum(change)[: len(data)] > 0
                out, base = [], 0
                for i, n in enumerate(lengths):
                    own, mark = data[base : base + n], covered[base : base + n]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mark.view(np.int8), [0]])))
                    out.append((row.doc_ids[i], row.nulls[i], n, edges, own[~mark].tobytes() if len(edges) else own.tobytes()))
                    base += n
                for a in range(0, len(out), 200):
                    yield pd.DataFrame(out[a : a + 200], columns=["doc_id", "is_null", "n_bytes", "spans", "kept"])

    return run


def _per_batch(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "body")).alias(name))


def remove_repeats(documents: DataFrame, batch_bytes: int = BATCH_BYTES, hot_batches: int = HOT_BATCHES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Cut repeated strings of LENGTH bytes out of all documents but the one with the smallest doc_id.

    Returns doc_id, n_bytes, spans (start and end of each removed run, flat, in bytes) and kept (the bytes left, in order) per
    input row. A null text is empty. Rows of equal doc_id do not match each other; rows with a null doc_id come after all
    others. An empty table gives no rows.
    """
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text"))
    batches = stored(rows.mapInPandas(_pack(batch_bytes), BATCHES), "batches")
    size = batches.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(8, -(-size // bucket_bytes))
    keys = batches.mapInPandas(_send_keys(buckets), SENT).groupBy("bucket").applyInPandas(_answer_keys(hot_batches), ANSWERED)
    keys = stored(keys, "shared-keys")
    known = batches.join(_per_batch(keys, "answers"), "batch", "left")
    windows = stored(known.mapInPandas(_send_runs(buckets), SENT).groupBy("bucket").applyInPandas(_answer_runs, ANSWERED), "windows")
    cut = known.join(_per_batch(windows, "windows"), "batch", "left").mapInPandas(_cut(buckets), CUT)
    return cut.select(F.when(~F.col("is_null"), F.col("doc_id")).alias("doc_id"), "n_bytes", "spans", "kept")


def repeats_digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 per input row."""
    removed = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return remove_repeats(documents).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
