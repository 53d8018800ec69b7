"""Near-duplicate groups by HyperMinHash (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veleta.llm.common import small_batches, stored, text_of
from veleta.llm.components import components

WORDS = 5
PERCENT = 85
REGISTERS = 128
BAND = 4  # registers of a band, 16 bits each: a band is one long
MANTISSA = 10  # bits kept below the leading one; the six above count leading zeros
SLACK = 6.0  # standard deviations by which an estimate may miss the limit before a pair is dropped
BLOCK = 512  # rows of a bucket that are compared with each other at a time
WHOLE = 256  # sets up to this size travel whole to where a bucket's classes are compared
SAMPLE = 512  # smallest hashes of larger ones, half as long
MEMO_WORDS = 250_000

_VALUE_BITS = 57  # of a 64-bit hash the upper 7 name the register
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_word_hash: dict[bytes, int] = {}


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle, one without words none."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    if len(_word_hash) > MEMO_WORDS:  # frequent words come early: the older half stays
        for w in list(islice(_word_hash, MEMO_WORDS // 2, None)):
            del _word_hash[w]
    for w in parts:
        if w not in _word_hash:
            _word_hash[w] = xxhash.xxh3_64_intdigest(w)
    hashes = np.fromiter(map(_word_hash.__getitem__, parts), dtype=np.uint64, count=len(parts))
    n = min(words, len(parts))
    with np.errstate(over="ignore"):
        mixed = np.full(len(parts) - n + 1, np.uint64(n))
        for i in range(n):
            mixed = mixed * _MIX[0] + hashes[i : len(parts) - n + 1 + i]
        mixed = (mixed ^ (mixed >> np.uint64(30))) * _MIX[1]
        mixed = (mixed ^ (mixed >> np.uint64(27))) * _MIX[2]
        return np.unique(mixed ^ (mixed >> np.uint64(31)))


_STARTS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(_VALUE_BITS)
_DONORS = np.random.default_rng(7).integers(0, REGISTERS, (REGISTERS, 48))


def signature(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a non-empty set: leading zeros and mantissa bits of the smallest value in each.

    Empty registers take the register of another one, chosen by a fixed random row of tries, so that small sets have
    full bands too and equal registers stay as likely as equal shares of the sets.
    """
    first = np.searchsorted(hashes, _STARTS)
    last = np.append(first[1:], len(hashes))
    filled = first < last
    values = hashes[np.minimum(first, len(hashes) - 1)] & np.uint64((1 << _VALUE_BITS) - 1)
    # 53 bits are exact as doubles: exponent and leading mantissa bits of the value are those of the double
    scaled = (values >> np.uint64(_VALUE_BITS - 53)).astype(np.float64)
    fraction, exponent = np.frexp(np.maximum(scaled, 1.0))
    zeros = np.minimum(53 - exponent, 63).astype(np.uint16)
    mantissa = ((fraction - 0.5) * 2 ** (MANTISSA + 1)).astype(np.uint16)
    registers = (zeros << np.uint16(MANTISSA)) | mantissa
    if not filled.all():
        tries = filled[_DONORS]
        donor = _DONORS[np.arange(REGISTERS), tries.argmax(axis=1)]
        none = ~tries.any(axis=1)
        donor[none] = np.flatnonzero(filled)[0]
        registers = np.where(filled, registers, registers[donor])
    return registers


def digest_of(hashes: np.ndarray) -> str:
    return blake2b(hashes.tobytes(), digest_size=16).hexdigest()


SIGNED = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("registers", T.BinaryType()),
])


@F.pandas_udf(SIGNED)
def _signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for text in texts:
            hashes = shingle_set(text)
            rows.append((len(hashes), digest_of(hashes), signature(hashes).tobytes()) if len(hashes) else (0, None, None))
        yield pd.DataFrame(rows, columns=["n", "digest", "registers"])


@F.pandas_udf(T.BinaryType())
def _packed_set(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).tobytes() for t in texts], dtype=object)


def estimated(matches: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimate from equal registers, less those expected to be equal by chance.

    Smallest values of two unlike sets fall into one cell of exponent and mantissa with chance
    ab / (a + b)^2 / (2 ln 2) / 2^mantissa bits, for sets of a and b values.
    """
    chance = na * nb / (na + nb) ** 2 / (2 * np.log(2)) / 2**MANTISSA
    share = matches / REGISTERS
    return (share - chance) / (1 - chance)


def likely(matches: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Pairs whose sizes allow the limit and whose estimate is not below it by more than the slack."""
    limit, larger = percent / 100, np.maximum(na, nb)
    error = np.sqrt(limit * (1 - limit) / np.minimum(REGISTERS, larger))
    return (100 * np.minimum(na, nb) >= percent * larger) & (estimated(matches, na, nb) >= limit - SLACK * error)


def _likely_udf(percent: int):
    @F.pandas_udf("boolean")
    def run(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        if not len(ra):
            return pd.Series([], dtype=bool)
        a, b = (np.frombuffer(b"".join(r), dtype=np.uint16).reshape(-1, REGISTERS) for r in (ra, rb))
        return pd.Series(likely((a == b).sum(axis=1), na.to_numpy(np.float64), nb.to_numpy(np.float64), percent))

    return run


def _linked_udf(percent: int):
    @F.pandas_udf("boolean")
    def run(sa: pd.Series, sb: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(sa, sb):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    return run


SAMPLED = T.StructType([T.StructField("sample", T.BinaryType()), T.StructField("digest", T.StringType())])


@F.pandas_udf(SAMPLED)
def _sampled(texts: pd.Series) -> pd.DataFrame:
    """The whole set if it is small, else the upper halves of its smallest hashes; and the set's digest."""
    rows = []
    for text in texts:
        x = shingle_set(text)
        rows.append((x.tobytes() if len(x) <= WHOLE else (x[:SAMPLE] >> np.uint64(32)).astype(np.uint32).tobytes(), digest_of(x)))
    return pd.DataFrame(rows, columns=["sample", "digest"])


def _sample_of(data: bytes, n: int) -> np.ndarray:
    return (np.frombuffer(data, dtype=np.uint64) >> np.uint64(32)).astype(np.uint32) if n <= WHOLE else np.frombuffer(data, dtype=np.uint32)


def sampled_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Share of hashes that both have among the smallest of either; the Jaccard index itself where both are whole."""
    both = np.sort(np.concatenate([a, b]))
    if len(a) == SAMPLE or len(b) == SAMPLE:  # beyond the smaller of the last hashes, a sample is silent
        last = min(x[-1] for x in (a, b) if len(x) == SAMPLE)
        both = both[: np.searchsorted(both, last, side="right")]
    twice = int((both[1:] == both[:-1]).sum())
    return twice / max(len(both) - twice, 1)


def _across(percent: int):
    """Pairs between different components, block against block of each bucket.

    A pair is looked at in the first bucket that it shares. Small sets are compared whole, and a link joins its components
    at once, so that these give no more links than a tree has. Of larger sets, pairs pass whose sample allows a link.
    """
    limit = percent / 100

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        frame = frame.sort_values(["key", "i", "j", "node"], kind="stable")
        node, label = frame["node"].to_numpy(), frame["label"].to_numpy()
        n, block = frame["n"].to_numpy(np.float64), frame["block"].to_numpy()
        place, band, sample = frame[["key", "i", "j"]].to_numpy(), frame["band"].to_numpy(), frame["sample"].tolist()
        registers = np.frombuffer(b"".join(frame["registers"]), dtype=np.uint16).reshape(-1, REGISTERS)
        bands = registers.view(np.uint64)
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        cuts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(frame)]):
            rows = np.arange(a, b)
            left, right = rows[block[a:b] == place[a, 1]], rows[block[a:b] == place[a, 2]]
            for x in left:
                others = right[(label[right] != label[x]) & (node[right] > node[x] if place[a, 1] == place[a, 2] else node[right] != node[x])]
                others = others[100 * np.minimum(n[others], n[x]) >= percent * np.maximum(n[others], n[x])]
                others = others[(bands[others] == bands[x])[:, : band[a]].sum(axis=1) == 0] if len(others) else others
                if not len(others):
                    continue
                good = others[likely((registers[others] == registers[x]).sum(axis=1), n[others], np.full(len(others), n[x]), percent)]
                for y in good:
                    p, q = root(label[x]), root(label[y])
                    if p == q:
                        continue
                    if max(n[x], n[y]) <= WHOLE:
                        own, other = (np.frombuffer(sample[z], dtype=np.uint64) for z in (x, y))
                        both = len(np.intersect1d(own, other, assume_unique=True))
                        if 100 * both < percent * (n[x] + n[y] - both):
                            continue
                        joined[max(p, q)] = min(p, q)
                    else:
                        most = SAMPLE if max(n[x], n[y]) > SAMPLE else 10**6
                        if sampled_jaccard(_sample_of(sample[x], n[x]), _sample_of(sample[y], n[y])) < limit - SLACK * np.sqrt(limit * (1 - limit) / most):
                            continue
                    found.append((min(node[x], node[y]), max(node[x], node[y])))
        return pd.DataFrame(found, columns=["a", "b"]).astype(np.int64)

    return run


class NearCopies:
    """One run over a table of documents."""

    def __init__(self, documents: DataFrame, percent: int = PERCENT):
        self.percent = percent
        small_batches(documents.sparkSession)
        self.texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        self.rows = stored(self.texts.select("doc_id", _signed("text").alias("s")).select("doc_id", "s.*"), "signatures")
        # equal sets are one class, named by its smallest doc_id
        classes = self.rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
        self.classes = stored(classes, "classes")
        named = self.classes.select("digest", F.col("node").alias("doc_id")).filter("doc_id IS NOT NULL")
        self.nodes = stored(
            self.rows.join(named, ["digest", "doc_id"]).select(F.col("doc_id").alias("node"), "digest", "n", "registers").dropDuplicates(["node", "digest"]), "nodes")

    def buckets(self) -> DataFrame:
        """key, band, node, n, size and centre of the bands that at least two classes share.

        ``centre`` is, of the bucket's classes, the one that shares most with others: the likely original of a group.
        """
        count = REGISTERS // BAND
        bands = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * (2 * BAND) + 1, F.lit(2 * BAND))))
        keyed = self.nodes.select("node", "n", F.posexplode(bands).alias("band", "key"))
        shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least")).filter("size > 1")
        rows = stored(keyed.join(shared, "key"), "bands")
        weight = rows.groupBy("node").agg(F.sum(F.log2("size")).alias("weight"))
        weighed = rows.join(weight, "node")
        centres = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("other"))).alias("top"))
        return stored(rows.join(centres.select("key", (-F.col("top")["other"]).alias("centre")), "key"), "buckets")

    def star_pairs(self, buckets: DataFrame) -> DataFrame:
        """Every class with the smallest and the most central class of each of its buckets."""
        pairs = buckets.select(F.explode(F.array("least", "centre")).alias("pivot"), "node").filter(F.col("pivot") != F.col("node"))
        pairs = pairs.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
        # classes that share a doc_id have one node; their first set stands for it here, all sets when pairs are verified
        side = {c: self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("registers").alias(f"r{c}")) for c in "ab"}
        return pairs.join(side["a"], "a").join(side["b"], "b").filter(_likely_udf(self.percent)("ra", "rb", "na", "nb")).select("a", "b").distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are links on their full sets."""
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            return pairs
        ends = stored(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ends")
        sets = stored(self.texts.join(ends, "doc_id", "left_semi").select("doc_id", _packed_set("text").alias("set")), "sets")
        side = {c: sets.select(F.col("doc_id").alias(c), F.col("set").alias(f"s{c}")) for c in "ab"}
        return stored(pairs.join(side["a"], "a").join(side["b"], "b").filter(_linked_udf(self.percent)("sa", "sb")).select("a", "b").distinct(), "verified")

    def cross_pairs(self, buckets: DataFrame, labels: DataFrame) -> DataFrame:
        """Likely pairs in buckets that still hold different components. Large buckets are compared in blocks."""
        rows = buckets.select("key", "band", "node", "size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
        rows = stored(rows.join(mixed, "key", "left_semi"), "mixed")
        ends = stored(rows.select(F.col("node").alias("doc_id")).distinct(), "mixed-ends")
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        groups = (rows.agg(F.sum(blocks)).first()[0] or 0) // 4_000 + 1
        samples = self.texts.join(ends, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), _sampled("text").alias("s"))
        samples = stored(samples.select("node", "s.*"), "samples").dropDuplicates(["node", "digest"])
        rows = rows.join(self.nodes.join(samples, ["node", "digest"]).select("node", "n", "registers", "sample"), "node")
        rows = rows.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("node"), blocks).cast("int")})
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        kept = ["key", "band", "node", "label", "n", "registers", "sample", "block"]
        dealt = rows.select(*kept, other).select(*kept, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        dealt = dealt.withColumn("group", F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups)))
        return dealt.groupBy("group").applyInPandas(_across(self.percent), "a LONG, b LONG").distinct()

    def same_ids(self) -> DataFrame:
        """Links between classes that hold rows of one doc_id: from a class named by the id to any other that has it."""
        held = self.rows.join(self.classes.select("digest", "node"), "digest").filter(F.col("doc_id") != F.col("node"))
        names = self.nodes.select(F.col("node").alias("doc_id")).distinct()
        return held.join(names, "doc_id", "left_semi").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct()

    def groups(self) -> DataFrame:
        """doc_id, n_shingles, component_id and kept."""
        buckets = self.buckets()
        star = self.verified(self.star_pairs(buckets))
        tried = self.cross_pairs(buckets, components(star))
        more = self.verified(tried)
        labels = components(star.unionByName(more).unionByName(self.same_ids()))
        named = self.classes.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("component_id"))
        out = self.rows.join(named, "digest", "left")
        component = F.coalesce("component_id", "doc_id")
        return out.select(
            "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
            F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def near_copies(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Groups of documents linked by 5-word shingles, directly or through others.

    Sets of equal shingles are one class. Bands of compressed registers bring classes together; each is tried with the smallest
    and the most central class of its buckets, and links are confirmed on full sets. Where a bucket still holds
    different components, all likely pairs between these are confirmed too, so a link between different texts is lost only
    if it shares none of 32 bands (chance below 1e-9 at the limit) or is under-estimated by six standard deviations.

    Returns doc_id, n_shingles, component_id and kept per input row. A null or empty text has no shingles and is a
    group of its own. Rows of one doc_id are one document in links. A row with a null doc_id belongs to the group of its
    equal texts, and is kept only where these have no doc_id either. An empty table gives no rows.
    """
    return NearCopies(documents, percent).groups()


ORACLE_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {WORDS} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i : i + {WORDS - 1}], ' ')) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= {PERCENT} * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN comp ON comp.node = doc_id
"""
