"""Quality rules compiled into one projection (operator 7). Spark expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veleta.llm.common import WORD, text_of, word_list

# --- fixed values: frequent function words of the four languages ------------------------
STOP_WORDS = {
    "en": "the of and to a in is that it for was on with be as this by at are from".split(),
    "fr": "de la le et les des en un une du que est pour qui sur dans par au pas avec".split(),
    "de": "der die und in den von zu das mit sich des auf für im ist nicht dem ein eine als".split(),
    "es": "de la que el en y los se las del un por con una no para al su es lo".split(),
}
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``; a side that is None does not bind, nor does a zero denominator."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        n, d = F.col(self.numerator), F.col(self.denominator)
        out = F.lit(True)
        if self.low is not None:
            out = out & (n >= F.lit(self.low) * d)
        if self.high is not None:
            out = out & (n <= F.lit(self.high) * d)
        return (d == 0) | out


RULES = (
    Rule("word length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop words", "n_stop_words", "n_words", low=0.06),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=0.5),
)
MIN_WORDS = 50
REPEAT_PERCENT = 50
POSITION_BITS = 24


def _keys() -> Column:
    """A long per 3-word window: bits of its hash above its position, so that sorting brings equal windows together."""
    windows = F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)))
    return F.sort_array(
        F.transform(
            windows,
            lambda w, i: F.shiftleft(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)), POSITION_BITS).bitwiseOR(i.cast("long")),
        )
    )


def _suspects() -> Column:
    """Positions of windows whose hash bits another window shares; every position where those do not fit."""
    def bits(c: Column) -> Column:
        return F.shiftright(c, POSITION_BITS)

    shared = F.filter("keys", lambda k, j: (bits(k) == bits(F.get("keys", j + 1))) | (bits(k) == bits(F.get("keys", j - 1))))
    positions = F.transform(shared, lambda k: k.bitwiseAND((1 << POSITION_BITS) - 1).cast("int"))
    every = F.sequence(F.lit(0), F.col("n_words").cast("int") - 3)
    return F.when(F.col("n_words") < 3, F.array().cast("array<int>")).when(F.col("n_words") >= 1 << POSITION_BITS, every).otherwise(positions)


def _in_word_order() -> Column:
    """The suspects with their words, sorted by these: equal windows stand next to each other, whatever their hashes."""
    return F.sort_array(
        F.transform("suspects", lambda p: F.struct(
            F.get("words", p).alias("a"), F.get("words", p + 1).alias("b"), F.get("words", p + 2).alias("c"), p.alias("p")))
    )


def _repeated() -> Column:
    def same(x: Column, y: Column) -> Column:
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    kept = F.filter("ordered", lambda x, j: F.coalesce(same(x, F.get("ordered", j + 1)), F.lit(False))
                    | F.coalesce(same(x, F.get("ordered", j - 1)), F.lit(False)))
    return F.sort_array(F.transform(kept, lambda x: x["p"]))


def _covered() -> Column:
    """Words in the repeated windows: each window adds three, less what the one before it covers."""
    fresh = F.transform("repeated", lambda p, j: F.least(F.lit(3), p - F.coalesce(F.get("repeated", j - 1), p - 3)).cast("long"))
    return F.aggregate(fresh, F.lit(0).cast("long"), lambda a, x: a + x)


def measures(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_stop_words of every whole text."""
    stop = sorted({form for words in STOP_WORDS.values() for w in words for form in (w, w.capitalize(), w + ".", w + ",")})
    text = documents.select("doc_id", text_of().alias("text")).withColumn("words", word_list(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    counted = text.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"), lines.alias("lines"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size(F.filter("words", lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
        F.when(F.size("words") < 1 << POSITION_BITS, _keys()).otherwise(F.array().cast("array<long>")).alias("keys"),
    )
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_stop_words"]
    line_counts = [
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    ]
    counted = counted.select(*counts, *line_counts, "words", _suspects().alias("suspects"))
    counts += ["n_lines", "n_dup_lines"]
    ordered = counted.select(*counts, F.when(F.size("suspects") == 0, None).otherwise(_in_word_order()).alias("ordered"))
    repeated = ordered.select(*counts, _repeated().alias("repeated"))
    return repeated.select(*counts, F.coalesce(_covered(), F.lit(0)).cast("long").alias("n_repeat_words"))


def quality_rules(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Judge every whole text by the base limits and the threshold table.

    Returns doc_id, the counts, base_failed and kept per input row. A null or empty text has no words and
    fails the base. Null and repeated doc_ids keep their rows; an empty table gives no rows.
    """
    words, repeats = F.col("n_words"), F.col("n_repeat_words")
    failed = (words < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * words)
    passed = F.lit(True)
    for rule in rules:
        passed = passed & rule.holds()
    return measures(documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & passed).alias("kept"), "n_lines", "n_stop_words",
    )


def _oracle() -> str:
    stop = sorted({form for words in STOP_WORDS.values() for w in words for form in (w, w.capitalize(), w + ".", w + ",")})
    checks = []
    for r in RULES:
        sides = [f"{r.numerator} >= {r.low}::DOUBLE * {r.denominator}"] if r.low is not None else []
        sides += [f"{r.numerator} <= {r.high}::DOUBLE * {r.denominator}"] if r.high is not None else []
        checks.append(f"({r.denominator} = 0 OR ({' AND '.join(sides)}))")
    listed = ", ".join(f"'{w}'" for w in stop)
    return f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM t),
tri AS (SELECT r, i, ws[i:i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY 1),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
  len(list_filter(ws, lambda x: x IN ({listed})))::BIGINT AS n_stop_words FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(checks)} AS kept, n_lines, n_stop_words FROM b
"""


ORACLE_SQL = _oracle()
