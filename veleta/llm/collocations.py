"""Phrases mined from texts by vertically partitioned, depth-truncated suffix subtrees (operator 12).

Every word begins a suffix of at most five words within its piece. Prefixes of suffixes are counted word by word: only those
that occur often enough are followed further, and a filter of fixed size tells tasks which these are. What remains is
dealt by prefix: prefixes whose suffixes fit a task's budget are grouped until the budget is full, larger ones are cut
into longer prefixes. Each group's subtree is built by itself, and phrase counts are totals of the leaves below a node.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veleta.llm.common import slices, stored, text_of

LEAST = 100  # occurrences of a candidate
LONGEST = 5  # words of a candidate
REPORT = 2_000  # phrases of a language
GROUP_SUFFIXES = 400_000  # distinct suffixes in one task's subtrees
FILTER_BITS = 27  # at most 16 MiB
HASHES = 4
FLUSH = 1_000_000  # distinct phrases that a task holds before it hands on their counts
KNOWN = 600_000  # words that a task remembers

# lower case; a piece ends at punctuation and line ends; a tab is a blank
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_BREAK = b"."  # no word holds it
COUNTS = "lang STRING, phrase BINARY, n LONG"


def _words(texts: list[str]) -> list[bytes]:
    """Words of all texts; a break stands between pieces."""
    return "\n".join(texts).encode("utf-8").translate(_FOLD).replace(b"\n", b" . ").split()


class PhraseFilter:
    """A Bloom filter of phrases per language, of a size that does not grow beyond ``FILTER_BITS``."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    @staticmethod
    def of(phrases: DataFrame, rows: int) -> PhraseFilter:
        bits = min(FILTER_BITS, max(10, (16 * rows).bit_length()))
        key = F.xxhash64(F.concat(F.encode("lang", "utf-8"), F.lit(b" "), F.col("phrase")))
        low, high = key.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(key, 32)
        places = F.explode(F.array(*[(low + i * high).bitwiseAND(F.lit(2**bits - 1)) for i in range(HASHES)])).alias("bit")
        table = phrases.select(places).groupBy(F.shiftright("bit", 6).alias("word")).agg(
            F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("value")).toPandas()  # 2 ** (FILTER_BITS - 6) rows at most
        words = np.zeros(2 ** (bits - 6), dtype=np.uint64)
        words[table["word"].to_numpy(np.int64)] = table["value"].to_numpy(np.int64).view(np.uint64)
        return PhraseFilter(words)

    def holds(self, lang: bytes, phrases: list[bytes]) -> np.ndarray:
        head = lang + b" "
        keys = np.fromiter((xxhash.xxh64_intdigest(head + p, 42) for p in phrases), dtype=np.uint64, count=len(phrases))
        low, high = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32)
        out = np.ones(len(phrases), dtype=bool)
        for i in range(HASHES):
            bit = (low + np.uint64(i) * high) & self.mask
            out &= (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return out


def _by_lang(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[str]]]:
    for frame in slices(frames, 2048):
        for lang, own in frame.groupby("lang")["text"]:
            yield lang, own.tolist()


def _frame(lang: str, phrases: list[bytes], counts: list[int]) -> pd.DataFrame:
    return pd.DataFrame({"lang": lang, "phrase": phrases, "n": counts})


def _count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, Counter] = {}

    def handed_on() -> Iterator[pd.DataFrame]:
        for lang, counts in held.items():
            counts.pop(_BREAK, None)
            yield _frame(lang, list(counts), list(counts.values()))
        held.clear()

    for lang, texts in _by_lang(frames):
        held.setdefault(lang, Counter()).update(_words(texts))
        if sum(map(len, held.values())) > FLUSH:
            yield from handed_on()
    yield from handed_on()


class _Numbers:
    """Numbers of a language's frequent words in one task; others, and breaks, have none (-1)."""

    def __init__(self, lang: str, frequent: PhraseFilter):
        self.lang, self.frequent, self.known, self.names = lang.encode("utf-8"), frequent, {_BREAK: -1}, []
        self.codes, self.linked = np.array([], dtype=np.int64), np.array([], dtype=bool)  # pairs that were looked up

    def of(self, words: list[bytes]) -> np.ndarray:
        fresh = list(set(words).difference(self.known))
        for word, frequent in zip(fresh, self.frequent.holds(self.lang, fresh).tolist()):
            if frequent:
                self.known[word] = len(self.names)
                self.names.append(word)
            else:
                self.known[word] = -1
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))

    def are_linked(self, codes: np.ndarray, pairs: PhraseFilter) -> np.ndarray:
        """Whether each of these sorted, distinct pairs is a frequent one."""
        at = np.searchsorted(self.codes, codes)
        known = self.codes[np.minimum(at, len(self.codes) - 1)] == codes if len(self.codes) else np.zeros(len(codes), dtype=bool)
        fresh = codes[~known]
        out = np.zeros(len(codes), dtype=bool)
        out[known] = self.linked[at[known]]
        out[~known] = found = pairs.holds(self.lang, self.phrases(_pair_rows(fresh)))
        if len(self.codes) > 2 * FLUSH:
            self.codes, self.linked = fresh, found
        else:
            every = np.concatenate([self.codes, fresh])
            order = np.argsort(every, kind="stable")
            self.codes, self.linked = every[order], np.concatenate([self.linked, found])[order]
        return out

    def phrases(self, rows: np.ndarray) -> list[bytes]:
        """Words of each row of numbers, joined; -1 ends a row."""
        get = self.names.__getitem__
        if rows.shape[1] == 2:
            return [a + b" " + b for a, b in zip(map(get, rows[:, 0].tolist()), map(get, rows[:, 1].tolist()))]
        return [b" ".join([get(i) for i in row if i >= 0]) for row in rows.tolist()]


def _pairs(ids: np.ndarray) -> np.ndarray:
    """Code of the pair that begins at each word; -1 where one of the two is not frequent."""
    both = (ids[:-1] >= 0) & (ids[1:] >= 0)
    return np.where(both, (ids[:-1] << 32) | ids[1:], -1)


def _pair_rows(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes >> 32, codes & 0xFFFFFFFF], axis=1)


def _counted(frames: Iterator[pd.DataFrame], frequent: PhraseFilter, take) -> Iterator[pd.DataFrame]:
    """Counts of the rows of numbers that ``take`` finds in a language's texts, handed on when there are many."""
    langs: dict[str, _Numbers] = {}
    held: dict[str, list[np.ndarray]] = {}

    def handed_on() -> Iterator[pd.DataFrame]:
        for lang, parts in held.items():
            found = np.concatenate(parts)
            rows, counts = np.unique(found, axis=0 if found.ndim > 1 else None, return_counts=True)
            rows = rows if rows.ndim > 1 else _pair_rows(rows)
            yield _frame(lang, langs[lang].phrases(rows), counts.tolist())
        held.clear()

    for lang, texts in _by_lang(frames):
        if lang not in langs:
            langs[lang] = _Numbers(lang, frequent)
        found = take(langs[lang], _words(texts))
        if len(found):
            held.setdefault(lang, []).append(found)
        full = sum(len(x.known) for x in langs.values()) > KNOWN
        if full or sum(len(p) for parts in held.values() for p in parts) > 2 * FLUSH:
            yield from handed_on()
        if full:
            langs = {}
    yield from handed_on()


def _count_pairs(frequent: PhraseFilter):
    def take(numbers: _Numbers, words: list[bytes]) -> np.ndarray:
        codes = _pairs(numbers.of(words))
        return codes[codes >= 0]

    return lambda frames: _counted(frames, frequent, take)


def _count_suffixes(frequent: PhraseFilter, pairs: PhraseFilter, longest: int):
    """Suffixes of three words and more, each as far as its pairs are frequent."""

    def take(numbers: _Numbers, words: list[bytes]) -> np.ndarray:
        ids = numbers.of(words)
        codes, back = np.unique(_pairs(ids), return_inverse=True)
        linked = codes >= 0
        linked[linked] = numbers.are_linked(codes[linked], pairs)
        linked = linked[back]  # whether a word and the next one make a frequent pair
        reach = linked.astype(np.int64)  # frequent pairs in a row from here
        for step in range(1, longest - 1):
            inner = reach[: max(len(reach) - step, 0)]
            inner += linked[step:] & (inner == step)
        at = np.flatnonzero(reach >= 2)
        rows = np.full((len(at), longest), -1, dtype=np.int32)
        for k in range(longest):
            own = reach[at] >= k
            rows[own, k] = ids[at[own] + k]
        return rows

    return lambda frames: _counted(frames, frequent, take)


def prefix_groups(suffixes: DataFrame, group_suffixes: int = GROUP_SUFFIXES, longest: int = LONGEST) -> DataFrame:
    """Give every distinct suffix the group of its prefix: lang, phrase, n, depth (words of the prefix) and task.

    Prefixes begin with one word. Those with more suffixes than a group may hold are cut into prefixes one word longer;
    the others are put into groups by running totals of their sizes, within slots that hold several groups each.
    """
    text, rest, out = F.col("phrase").cast("string"), suffixes, None
    for depth in range(1, longest + 1):
        keyed = rest.withColumn("prefix", F.substring_index(text, " ", depth))
        sizes = stored(keyed.groupBy("lang", "prefix").agg(F.count(F.lit(1)).alias("size")), "prefixes")
        small = sizes.filter(F.lit(depth == longest) | (F.col("size") <= group_suffixes))
        total = small.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        slots = max(1, -(-total // (8 * group_suffixes)))
        slot = F.pmod(F.xxhash64("lang", "prefix"), F.lit(slots))
        before = Window.partitionBy("slot").orderBy("size", "lang", "prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        grouped = small.withColumn("slot", slot).select(
            "lang", "prefix", F.concat_ws("-", F.lit(depth), "slot", F.floor((F.sum("size").over(before) - 1) / group_suffixes)).alias("task"))
        routed = keyed.join(grouped, ["lang", "prefix"]).select("lang", "phrase", "n", F.lit(depth).alias("depth"), "task")
        out = routed if out is None else out.unionByName(routed)
        large = sizes.filter(F.col("size") > group_suffixes)
        if depth == longest or large.isEmpty():
            return out
        rest = stored(keyed.join(large.select("lang", "prefix"), ["lang", "prefix"], "left_semi").select("lang", "phrase", "n"), "longer")


def subtree_counts(least: int, longest: int):
    """Nodes of the subtrees of one task: suffixes sorted, common words of neighbours, totals of the leaves below.

    A node above a prefix's depth has leaves in other tasks too, so it is kept whatever its count here.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lang, own in frame.groupby("lang"):
            leaves = sorted(zip((p.split(b" ") for p in own["phrase"]), own["n"].tolist(), own["depth"].tolist()))
            lengths = np.array([len(w) for w, _, _ in leaves])
            counts = np.array([n for _, n, _ in leaves], dtype=np.int64)
            depths = np.array([d for _, _, d in leaves])
            common = np.zeros(len(leaves), dtype=np.int64)  # words shared with the leaf before
            for i in range(1, len(leaves)):
                a, b = leaves[i - 1][0], leaves[i][0]
                k = 0
                while k < len(a) and k < len(b) and a[k] == b[k]:
                    k += 1
                common[i] = k
            for depth in range(3, longest + 1):
                deep = lengths >= depth
                starts = np.flatnonzero(deep & (common < depth))
                if not len(starts):
                    continue
                totals = np.add.reduceat(np.where(deep, counts, 0), starts)
                keep = (totals >= least) | (depths[starts] > depth)
                out += [(lang, b" ".join(leaves[i][0][:depth]), int(n)) for i, n in zip(starts[keep], totals[keep])]
        return pd.DataFrame(out, columns=["lang", "phrase", "n"])

    return run


def phrase_counts(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, group_suffixes: int = GROUP_SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, n of all phrases of one to ``longest`` words that occur ``least`` times, and lang, n of all words."""
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))

    def counted(run) -> DataFrame:
        return texts.mapInPandas(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))

    enough = F.col("n") >= least
    words = stored(counted(_count_words), "words")
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    ones = stored(words.filter(enough), "frequent-words")
    frequent = PhraseFilter.of(ones, ones.count())
    twos = stored(counted(_count_pairs(frequent)).filter(enough), "frequent-pairs")
    pairs = PhraseFilter.of(twos, twos.count())
    suffixes = stored(counted(_count_suffixes(frequent, pairs, longest)), "suffixes")
    grouped = prefix_groups(suffixes, group_suffixes, longest)
    nodes = grouped.groupBy("task").applyInPandas(subtree_counts(least, longest), COUNTS)
    more = nodes.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(enough)
    as_text = lambda df: df.select("lang", F.col("phrase").cast("string").alias("phrase"), "n")
    return stored(as_text(ones).unionByName(as_text(twos)).unionByName(as_text(more)), "phrases"), totals


def _words_in(phrase: Column) -> Column:
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, report: int = REPORT, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """Each language's first phrases by score: lang, rank, phrase, a, l, r, n, score.

    A null text is an empty one, a null language ``und``. Repeated rows count again. An empty table gives no rows; other
    columns are ignored. A phrase whose count a phrase one word longer around it reaches is dropped: a count never
    grows with a phrase, so any longer phrase that reaches it passes through one of these.
    """
    phrases, totals = phrase_counts(documents, least, longest, group_suffixes)
    sized = phrases.withColumn("size", _words_in(F.col("phrase")))
    candidates = sized.filter("size > 1")
    inner = F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))
    covered = candidates.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), F.col("n").alias("longer"))
    most = covered.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(most, ["lang", "phrase"], "left").filter("longer is null or longer < n").drop("longer")
    cut = F.explode(F.expr("sequence(1, size - 1)")).alias("k")
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "size", cut).selectExpr(
        "lang", "phrase", "a", "k", "substring_index(phrase, ' ', k) as head", "substring_index(phrase, ' ', k - size) as tail")
    left = phrases.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    whole = cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"]).join(totals, "lang")
    # counts have at most 19 digits: products are exact as decimals of 38
    exact = whole.withColumn("score", F.expr("(cast(1000 * cast(a as decimal(16, 0)) as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"))
    lowest = exact.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("cut.a").desc(), F.col("phrase"))
    ranked = lowest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= report)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


ORACLE_SQL = """
with pieces as (
  select row_number() over () as piece, lang, regexp_extract_all(piece, '[^ \\t]+') as w from (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\x0C\\r]')) as piece
    from documents)),
words as (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces where len(w) > 0),
grams as (select lang, array_to_string(w[i : i + size - 1], ' ') as phrase, size from words, range(1, 6) t(size) where i + size - 1 <= len(w)),
f as (select lang, phrase, size, count(*) as n from grams group by all),
total as (select lang, sum(n)::hugeint as n from f where size = 1 group by lang),
candidate as (select * from f where size > 1 and n >= 100),
kept as (
  select c.* from candidate c where not exists (
    select 1 from candidate y where y.lang = c.lang and y.size > c.size and y.n >= c.n and contains(' ' || y.phrase || ' ', ' ' || c.phrase || ' '))),
cuts as (
  select lang, phrase, n as a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') as head, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') as tail
  from kept, range(1, 5) t(k) where k < size),
scored as (
  select c.lang, c.phrase, c.a, x.n as l, y.n as r, total.n, k, (1000::hugeint * c.a * total.n) // (x.n::hugeint * y.n) as score
  from cuts c join f x on x.lang = c.lang and x.phrase = head join f y on y.lang = c.lang and y.phrase = tail join total on total.lang = c.lang),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n::bigint as n, score::bigint as score
from lowest qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""
