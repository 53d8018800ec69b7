"""Mixing sources to target weights by weighted fair queueing (operator 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veleta.llm.common import stored, text_of, word_list

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = "mix-1"
BIN_ROWS = 50_000  # rows that one shuffle bin holds on average, at most
TIME_BINS = 4096  # bins of a unit of virtual time


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Target words per source: shares of all words by weight, none above ``most`` times its source.

    ``sizes`` has source_key and source_size, a row per source. Sources fill up in the order of limit over weight:
    one is at its limit if the level that the rest would get is not below that. Words are whole numbers, so every sum
    is exact.
    """
    by_name = Window.orderBy("source_key")
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")).cast("long"))
    weighed = weighed.withColumn("most", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "source_key")
    whole = Window.partitionBy()
    filling = weighed.select(
        "*", F.sum("source_size").over(whole).alias("total"),
        F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
    )
    full = F.col("most") * F.col("rest") <= (F.col("total") - F.col("below")) * F.col("weight")
    filling = filling.withColumn("full", full)
    levels = filling.select(
        "*", F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(whole).alias("taken_full"),
        F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole).alias("open_weight"),
    )
    level = (F.col("total") - F.col("taken_full")).cast("double") / F.col("open_weight").cast("double")
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(level * F.col("weight").cast("double"))
    return levels.select("source_key", "source_size", target.alias("target"))


def queued(rows: DataFrame) -> DataFrame:
    """Add ``upto``: the words of the row's source up to and with the row, in shuffled order.

    A source may hold most rows, so its order is cut into bins of the shuffle key: totals per bin give what
    stands before a bin, and only one bin at a time is sorted.
    """
    count, digits = rows.count(), 0
    while count > BIN_ROWS * 16**digits and digits < 8:
        digits += 1
    binned = rows.withColumn("bin", F.substring("shuffle_key", 1, digits) if digits else F.lit(""))
    totals = binned.groupBy("source_key", "bin").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source_key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("source_key", "bin", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("source_key", "bin").orderBy("shuffle_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    inner = binned.withColumn("inner", F.sum("size").over(within))
    return inner.join(before, ["source_key", "bin"]).withColumn("upto", F.col("before") + F.col("inner")).drop("before", "inner", "bin")


def truncation(rows: DataFrame, most: int) -> tuple[float, str, int] | None:
    """The last copy within the budget, in the order of virtual finish time, source and place.

    Words per bin of virtual time give the bin in which the budget ends; only that bin is sorted.
    """
    place = F.col("copy") * F.col("source_size") + F.col("upto")
    copies = rows.filter((F.col("size") > 0) & (F.col("target") > 0)).select(
        "source_key", "size", "source_size", "upto", "target", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("copy"))
    copies = copies.select("source_key", "size", place.alias("place"), (place / F.col("target")).alias("finish"))
    copies = copies.withColumn("time_bin", F.floor(F.least(F.col("finish"), F.lit(4.0)) * TIME_BINS).cast("int"))
    budget = rows.groupBy("source_key").agg(F.first("source_size").alias("n")).agg(F.sum("n")).first()[0] or 0
    totals = copies.groupBy("time_bin").agg(F.sum("size").alias("words"))
    running = totals.withColumn("upto", F.sum("words").over(Window.orderBy("time_bin")))
    ends = running.filter(F.col("upto") > budget).orderBy("time_bin").select("time_bin", (F.col("upto") - F.col("words")).alias("before")).first()
    key = F.struct("finish", "source_key", "place")
    if ends is None:
        last = copies.agg(F.max(key).alias("k")).first()["k"]
    else:
        order = Window.orderBy("finish", "source_key", "place").rowsBetween(Window.unboundedPreceding, 0)
        inside = copies.filter(F.col("time_bin") == ends["time_bin"]).withColumn("upto", F.sum("size").over(order) + ends["before"])
        last = inside.filter(F.col("upto") <= budget).agg(F.max(key).alias("k")).first()["k"]
        last = last or copies.filter(F.col("time_bin") < ends["time_bin"]).agg(F.max(key).alias("k")).first()["k"]
    return tuple(last) if last else None


def _keyed(documents: DataFrame, seed: str) -> DataFrame:
    """The documents with source_key, size and shuffle_key; the last two and doc_id are a row's place in its source's queue."""
    return documents.withColumns({
        "source_key": F.coalesce(F.concat(F.lit("a"), F.col("source").cast("string")), F.lit("b")),
        "size": F.size(word_list(text_of())).cast("long"),
        "shuffle_key": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")))),
    })


def _queue(documents: DataFrame, weights: tuple[int, ...], most: int, seed: str) -> DataFrame:
    """doc_id, source, source_key, size, shuffle_key, upto, source_size and target of every row."""
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    rows = stored(_keyed(plain, seed).drop("text"), "mix-sizes")
    sizes = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    shares = stored(source_targets(sizes, weights, most), "mix-targets")
    return stored(queued(rows).join(shares, "source_key"), "mix-queue")


def _taken(copy: int, last: tuple[float, str, int]) -> Column:
    """Whether this copy of a row is not behind the last one that the budget takes."""
    limit = F.struct(F.lit(float(last[0])), F.lit(last[1]), F.lit(int(last[2])).cast("long"))
    place = F.lit(copy).cast("long") * F.col("source_size") + F.col("upto")
    counts = (F.col("size") > 0) & (F.col("target") > 0)
    return F.when(counts, F.struct(place / F.col("target"), F.col("source_key"), place) <= limit).otherwise(F.lit(False))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """How often each document enters the mix.

    Documents of a source queue in an order given by a digest of seed and doc_id, and again for each further copy. A
    copy's virtual finish time is the words of its source up to it over the source's target; the mix is the
    first copies by finish time that fit the total budget, which is the number of words in all documents.

    Returns doc_id, source, size, source_size, target, copies and taken per input row. A null text has no words and takes
    none; a null source is a source of its own, last in order; repeated rows queue one by one; an empty table gives no rows.
    """
    placed = _queue(documents, weights, most, seed)
    last = truncation(placed, most)
    copies = F.lit(0)
    if last:
        for copy in range(most):
            copies = copies + _taken(copy, last).cast("int")
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"),
        (copies.cast("long") * F.col("size")).alias("taken"),
    )


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """The documents as often as the mix takes them, with their columns as they came.

    Of each copy, a source gives the start of its queue. The last place taken, one per source and copy, therefore
    tells for every row what becomes of it, and texts need not be shuffled. Rows equal in doc_id and size share a place.
    """
    placed = _queue(documents, weights, most, seed)
    last = truncation(placed, most)
    if last is None:
        return documents.limit(0)
    place = F.struct("shuffle_key", "doc_id", "size")
    ends = [F.max(F.when(_taken(copy, last), place)).alias(f"end_{copy}") for copy in range(most)]
    ends = stored(placed.groupBy("source_key").agg(*ends), "mix-ends")
    names = documents.columns
    rows = documents.select(F.struct(*names).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    rows = _keyed(rows, seed).select("doc", "source_key", place.alias("place"), "size").join(ends, "source_key")
    copies = F.lit(0)
    for copy in range(most):
        copies = copies + F.coalesce(F.col("place") <= F.col(f"end_{copy}"), F.lit(False)).cast("int")
    counted = rows.select("doc", F.when(F.col("size") > 0, copies).otherwise(0).alias("copies")).filter("copies > 0")
    return counted.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col("doc")[n].alias(n) for n in names])


ORACLE_SQL = f"""
WITH rows AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS source_key,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS shuffle_key FROM documents),
sizes AS (SELECT source_key, sum(size)::BIGINT AS source_size FROM rows GROUP BY 1),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source_key) - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM sizes),
filling AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
  coalesce(sum(most) OVER (ORDER BY most / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below,
  (sum(weight) OVER (ORDER BY most / weight, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest FROM weighed),
stops AS (SELECT *, most * rest <= (total - below) * weight AS is_full FROM filling),
levels AS (SELECT *, (sum(CASE WHEN is_full THEN most ELSE 0 END) OVER ())::BIGINT AS taken_full,
  (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ())::BIGINT AS open_weight FROM stops),
shares AS (SELECT source_key, source_size, total,
  CASE WHEN is_full THEN most::DOUBLE ELSE ((total - taken_full)::DOUBLE / open_weight::DOUBLE) * weight::DOUBLE END AS target FROM levels),
queue AS (SELECT *, (sum(size) OVER (PARTITION BY source_key ORDER BY shuffle_key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM rows JOIN shares USING (source_key)),
copies AS (SELECT *, copy * source_size + upto AS place, (copy * source_size + upto)::DOUBLE / target AS finish
  FROM queue, (SELECT unnest([0, 1, 2])::BIGINT AS copy) WHERE size > 0 AND target > 0),
kept AS (SELECT * FROM copies QUALIFY sum(size) OVER (ORDER BY finish, source_key, place ROWS UNBOUNDED PRECEDING) <= total),
counts AS (SELECT doc_id, count(*) AS copies FROM kept GROUP BY 1)
SELECT doc_id, size, source_size, target, coalesce(copies, 0)::BIGINT * size AS taken FROM queue LEFT JOIN counts USING (doc_id)
"""
