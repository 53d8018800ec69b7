"""Exact top-k inner products by the threshold algorithm (operator 6)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veleta.llm.common import stored

K = 5
SCALE = 256
SHARD_ROWS = 8192
QUERY_ROWS = 512
FIRST_DEPTH = 64


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the integer components. Rows with a null id, vector or component, or a non-finite one, are left out."""
    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(F.forall("e", lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False)))
    return rows.select("vec_id", F.transform("e", lambda x: F.floor(x * scale)).alias("q"))


class SortedLists:
    """The rows of one shard, sorted by each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        # whole numbers below 2**53 are exact as floats, and their products are faster
        exact = rows.size == 0 or float(np.abs(rows).max()) < 2**20
        self.ids, self.rows = ids, rows.astype(np.float64) if exact else rows
        self.order = np.argsort(-self.rows, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.rows, self.order, axis=0)

    def top(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best rows for ``q``, ties to the smaller id.

        Lists are read from the end that the sign of the query's component favours, in rounds of doubling depth.
        Every row met is scored in full. A row not met yet scores at most the sum over dimensions of the component times the
        last value read; reading ends when the kth score is above that.
        """
        n = len(self.ids)
        q = q.astype(self.rows.dtype)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = self.ids == own
        best, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=self.rows.dtype)
        low, high = 0, min(FIRST_DEPTH, n)
        while True:
            met = np.zeros(n, dtype=bool)
            if low == 0 and not (len(up) or len(down)):
                met[:] = True
                high = n
            met[self.order[low:high, up].ravel()] = True
            met[self.order[n - high : n - low, down].ravel()] = True
            fresh = np.flatnonzero(met & ~seen)
            seen |= met
            best, scores = np.concatenate([best, fresh]), np.concatenate([scores, self.rows[fresh] @ q])
            if len(best) > k:
                edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                near = np.flatnonzero(scores >= edge)
                chosen = near[np.lexsort((self.ids[best[near]], -scores[near]))[:k]]
                best, scores = best[chosen], scores[chosen]
            if high >= n or seen.all():
                return best, scores
            bound = self.values[high - 1, up] @ q[up] + self.values[n - high, down] @ q[down]
            if len(best) == k and scores.min() > bound:
                return best, scores
            low, high = high, min(2 * high, n)


FOUND = "query_id LONG, vec_id LONG, score LONG"


def _search(k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(candidates) and len(queries):
            lists = SortedLists(candidates["vec_id"].to_numpy(), np.stack(candidates["q"].to_numpy()).astype(np.int64))
            for own, q in zip(queries["vec_id"], queries["q"]):
                at, scores = lists.top(own, np.asarray(q), k)
                found += zip([own] * len(at), lists.ids[at].tolist(), scores.astype(np.int64).tolist())
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, every: int = 50, k: int = K, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k best candidates of each query by integer inner product: query_id, rank, vec_id and score.

    Queries are the rows whose id is divisible by ``every``, candidates all rows with another id and the same number of
    components. Candidates are dealt to shards and queries to blocks, both of bounded size; every block meets every
    shard once, and the shards' best are ranked per query. Repeated candidate rows count each; rows that repeat a
    query's id are one query, the smallest vector. Scores are exact while components stay below 2**20.
    """
    rows = stored(quantised(vectors).withColumn("dims", F.size("q")), "quantised")
    count = rows.count()
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("q").alias("q")).withColumn("dims", F.size("q"))
    shards, blocks = max(1, -(-count // shard_rows)), max(1, -(-queries.count() // query_rows))
    candidates = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    keys = ["dims", "shard", "block"]
    found = candidates.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_search(k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS q FROM embeddings),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= {K}
"""
