"""Personal data: base patterns, and bootstrapped contexts that find identifiers of other shapes (operator 9)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veleta.llm.common import stored, text_of

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
LEAST_SEEDS = 5  # distinct known instances that a pattern must have
LEAST_PATTERN = 0.8  # confidence from which a pattern counts
LEAST_INSTANCE = 0.8  # score from which a new identifier is taken
MOST_IDENTIFIER = 200  # code points of an identifier
CONTEXT = 80  # code points on either side in which context words are looked for

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile("[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*")
_BLANKS = frozenset(" \t\n\x0b\f\r")
_CORE = re.compile(r"(?P<label>[^\W\d_]{2,30}[:=])?(?P<core>[A-Za-z0-9+@][A-Za-z0-9@._+/()-]{3,}[A-Za-z0-9])$")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """As a search for the pattern from left to right, but starting from each @: what stands before it starts the match."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            out.append(found.span())
            free = found.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    parts = ((m.span(), m.group().split(".")) for m in _IP.finditer(text))
    return [span for span, ps in parts if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in ps)]


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m.group())) <= 15]


_FINDERS = (_emails, _ips, _cards, _phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Kind number, start and end of the base patterns' matches, by kind and start."""
    if not _MARK.search(text):
        return []
    return [(kind, a, b) for kind, find in enumerate(_FINDERS) for a, b in find(text)]


def _plain(word: str) -> str:
    return _DIGITS.sub("0", word.lower().strip(".,;:!?()[]\"'<>"))


def _patterns(text: str, start: int, end: int, label: str) -> list[str]:
    """Lexical contexts of a place: a label glued to it, the two words before it, the word on either side."""
    before = [_plain(w) for w in text[max(0, start - CONTEXT) : start].split()[-2:]]
    after = [_plain(w) for w in text[end : end + CONTEXT].split()[:1]]
    out = [f"label {label.lower()}"] if label else []
    if len(before) == 2 and all(before):
        out.append(f"before {before[0]} {before[1]}")
    if before and after and before[-1] and after[0]:
        out.append(f"around {before[-1]} {after[0]}")
    return out


def _instance(value: str) -> str:
    return blake2b(value.lower().encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """Tokens that look like identifiers (four digits or an @) and overlap no base match: start, end, glued label."""
    spans = sorted((a, b) for _, a, b in taken)
    i, at = 0, 0
    while found := _MARK.search(text, at):
        start = found.start()
        while start > at and text[start - 1] not in _BLANKS:
            start -= 1
        end = _TOKEN.match(text, start).end()
        at = end
        if end - start > MOST_IDENTIFIER:
            continue
        token = text[start:end].rstrip(".,;:!?)]\"'>")
        shift = len(token) - len(token.lstrip("([\"'<"))
        core = _CORE.match(token[shift:])
        if not core or (len(_DIGITS.findall(core["core"])) < 4 and "@" not in core["core"]):
            continue
        a, b = start + shift + core.start("core"), start + shift + core.end("core")
        while i < len(spans) and spans[i][1] <= a:
            i += 1
        if not any(s < b and e > a for s, e in spans[i : i + 8]):
            yield a, b, core["label"] or ""


FOUND = T.StructType([
    T.StructField("base", T.StringType()), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("hits", T.ArrayType(T.StringType())),
])


def _scanned(text: str) -> tuple[str, list[int], list[str]]:
    spans = base_spans(text)
    hits = []
    if spans or _MARK.search(text):
        places = [(kind, a, b, "") for kind, a, b in spans] + [(-1, a, b, label) for a, b, label in _candidates(text, spans)]
        for kind, a, b, label in places:
            patterns = _patterns(text, a, b, label)
            if kind >= 0 or patterns:
                hits.append("\x1f".join([str(kind), str(a), str(b), _instance(text[a:b]), *patterns]))
    counts = [sum(k == kind for k, _, _ in spans) for kind in range(len(KINDS))]
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans), counts, hits


@F.pandas_udf(FOUND)
def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([_scanned(t) for t in texts], columns=["base", "counts", "hits"])


def pattern_scores(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Accepted instances of other shapes: kind, pattern and instance.

    ``edges`` has kind (-1 if unknown), pattern and instance, once each. A pattern's confidence for a kind is the score of
    its distinct instances for that kind over their number plus one; an unknown instance's score is the chance that one of
    its patterns is right. Known instances keep score 1 for their kind and 0 for others. Sums are combined map-side, and
    what does not change between rounds is written once, so a pattern or instance that very many share costs a row per task.
    """
    edges = stored(edges, "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    known = edges.filter("kind >= 0").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("known")).filter(F.col("known") >= LEAST_SEEDS)
    base = stored(known.join(sizes, "pattern"), "pii-patterns")
    unknown = stored(edges.filter("kind < 0").select("pattern", "instance").join(base.select("pattern").distinct(), "pattern", "left_semi"), "pii-unknown")
    scores = None
    for _ in range(rounds):
        gained = base.withColumn("gained", F.lit(0.0))
        if scores is not None:
            sums = unknown.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("gained"))
            gained = base.join(sums, ["pattern", "kind"], "left").withColumn("gained", F.coalesce("gained", F.lit(0.0)))
        confident = gained.select("pattern", "kind", ((F.col("known") + F.col("gained")) / (F.col("n") + 1)).alias("confidence"))
        confident = stored(confident.filter(F.col("confidence") >= LEAST_PATTERN), "pii-confident")
        reached = unknown.join(confident, "pattern")
        miss = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        scores = stored(reached.groupBy("instance", "kind").agg((1 - F.exp(miss)).alias("score")), "pii-scores")
    return reached.join(scores.filter(F.col("score") >= LEAST_INSTANCE), ["instance", "kind"], "left_semi").select("kind", "pattern", "instance")


def _hits(scanned: DataFrame) -> DataFrame:
    part = F.split("hit", "\x1f")
    places = scanned.select("row_no", F.explode("hits").alias("hit")).select("row_no", part.alias("p"))
    return places.select(
        "row_no", F.get("p", F.lit(0)).cast("int").alias("kind"), F.get("p", F.lit(1)).cast("int").alias("start"),
        F.get("p", F.lit(2)).cast("int").alias("end"), F.get("p", F.lit(3)).alias("instance"),
        F.explode(F.slice("p", F.lit(5), F.greatest(F.size("p") - 4, F.lit(0)))).alias("pattern"),
    )


def _listed(spans: Column) -> Column:
    """``kind:start:end`` of an array of (kind number, start, end), in that order, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(F.sort_array(spans), one), ",")


def find_pii(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Spans of personal data in every whole text.

    The base patterns' matches stay as they are. Tokens with four digits or an @ outside these are taken for a kind when they
    stand in contexts that known instances of that kind fill with confidence. Positions are code points, ends exclusive.

    Returns doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans (base and found) and the columns of
    ``carry`` per input row. A null text is an empty one; repeated rows keep their rows; an empty table gives no rows.
    """
    scanned = documents.select(F.struct(*[F.col(c) for c in carry]).alias("carried") if carry else F.lit(None).cast("int").alias("carried"),
                               F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    scanned = scanned.select("doc_id", "carried", _scan("text").alias("s")).select("doc_id", "carried", "s.*")
    scanned = stored(scanned.withColumn("row_no", F.monotonically_increasing_id()), "pii-scanned")
    hits = _hits(scanned)
    accepted = pattern_scores(hits.select("kind", "pattern", "instance").distinct())
    span = F.struct("kind", "start", "end")
    more = (
        hits.filter("kind < 0").drop("kind").join(accepted, ["pattern", "instance"])
        .groupBy("row_no", "start", "end").agg(F.min("kind").alias("kind"))
        .groupBy("row_no").agg(F.collect_list(span).alias("more"))
    )
    more = stored(more, "pii-found")  # of known size: where little is found, the rows with their texts need not move
    base = F.transform(
        F.filter(F.split("base", ","), lambda x: x != ""),
        lambda x: F.struct(
            (F.array_position(F.array(*map(F.lit, KINDS)), F.substring_index(x, ":", 1)) - 1).cast("int").alias("kind"),
            F.get(F.split(x, ":"), F.lit(1)).cast("int").alias("start"), F.get(F.split(x, ":"), F.lit(2)).cast("int").alias("end")))
    joined = scanned.join(more, "row_no", "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(_listed(F.concat(base, F.col("more"))))
    counts = [F.get("counts", F.lit(i)).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return joined.select(
        "doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"),
        *[F.col("carried")[c].alias(c) for c in carry if c != "doc_id"])


@F.pandas_udf(T.StringType())
def masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts with each span replaced by its kind in brackets; overlapping spans are replaced together, under the first's kind."""
    def one(text: str | None, listed: str) -> str | None:
        if not listed or text is None:
            return text
        places = sorted((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in listed.split(",")))
        out, at, until = [], 0, -1
        for a, b, kind in places:
            if a < until:
                until = max(until, b)
                at = until
                continue
            out += [text[at:a], f"[{kind.upper()}]"]
            at = until = b
        return "".join([*out, text[at:]])

    return pd.Series([one(t, s) for t, s in zip(texts, spans)], dtype=object)


def mask_pii(documents: DataFrame) -> DataFrame:
    """The documents with personal data masked in text and n_chars counted anew; other columns as they came."""
    names = documents.columns
    found = find_pii(documents, carry=tuple(names))
    out = found.withColumn("text", masked("text", "spans"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).cast(documents.schema["n_chars"].dataType))
    return out.select(*names)
