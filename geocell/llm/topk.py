"""Exact top-k search by inner product over an impact-ordered score-at-a-time index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

SCALE = 1024
BLOCK, QUERIES = 8192, 512


class ImpactIndex:
    """Postings of one block of integer vectors, dimension by dimension, in the order of value.

    For a query each dimension's values are shifted so that contributions are impacts of at least 0. Impacts are
    quantised by halving levels; segments, that is the postings of a dimension between two levels, are added in the order
    of descending level. A vector's sum so far is a lower bound, and the sum plus the level for each dimension not yet met
    is an upper one. It stops once the k-th lower bound proves that few vectors can still be members; all of these, ties
    included, are scored exactly.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(values, self.order.T, 0).T.copy()

    def search(self, query: np.ndarray, own: int, k: int, enough: int = 64) -> list[tuple[int, int]]:
        """(score, id) of the k best other than `own`."""
        n, dims = self.values.shape
        used = [d for d in range(dims) if query[d] and self.sorted[d][0] != self.sorted[d][-1]]
        low = np.zeros(n, np.int64)
        met = np.zeros(n, np.int64)
        other = self.ids != own
        possible = np.flatnonzero(other)
        done = {}
        level = max((abs(int(query[d])) * int(self.sorted[d][-1] - self.sorted[d][0]) for d in used), default=0)
        while level > 0 and len(possible) > max(k, enough):
            level = level // 2
            for d in used:
                weight, column = abs(int(query[d])), self.sorted[d]
                if query[d] > 0:  # impact: weight * (value - smallest), largest values first
                    a, b = int(np.searchsorted(column, column[0] + level / weight, "right")), done.get(d, n)
                    part, impact = self.order[d][a:b], (column[a:b] - column[0]) * weight
                    done[d] = min(a, b)
                else:
                    a, b = done.get(d, 0), int(np.searchsorted(column, column[-1] - level / weight, "left"))
                    part, impact = self.order[d][a:b], (column[-1] - column[a:b]) * weight
                    done[d] = max(a, b)
                low[part] += impact
                met[part] += 1
            bounds = low[possible]
            if len(bounds) > k:
                kth = np.partition(bounds, len(bounds) - k)[len(bounds) - k]
                possible = possible[bounds + (len(used) - met[possible]) * level >= kth]
        scores = self.values[possible] @ query
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return [(int(scores[i]), int(self.ids[possible[i]])) for i in best]


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v: floor(scale * component) as long. Vectors that are null or hold null, NaN or infinity go; empty ones stay
    and score 0 against each other."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", bad))
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def search(vectors: DataFrame, k: int = 10, every: int = 100, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for every vec_id divisible by `every`, the k other rows with the highest scores.

    Candidates and queries are dealt to blocks by a hash of vec_id; each pair of blocks is one task's work, of bounded
    size, so cost is queries x rows as the exact search asks, while no task and no broadcast grows with the table.

    Ties go to the smaller vec_id. Vectors of another length than the query's are no candidates for it. Null ids take no part.
    A repeated id is a candidate as often as it comes and one query for each length, with its smallest vector; it never
    finds its own id. Empty table: no row.
    """
    rows = written(quantised(vectors).withColumn("dims", F.size("v")))
    asked = F.col("vec_id") % every == 0
    n, m = rows.agg(F.count(F.lit(1)), F.count(F.when(asked, 1))).first()
    blocks, sets = max(1, -(-n // block)), max(1, -(-m // query_block))
    part = lambda count, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(count)).cast("int")
    every_set = F.explode(F.sequence(F.lit(0), F.lit(sets - 1)))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.select("vec_id", "v", "dims", F.lit(False).alias("is_query"), part(blocks, 1).alias("b"), every_set.alias("s"))
    right = rows.where(asked).groupBy("vec_id", "dims").agg(F.min("v").alias("v")).select("vec_id", "v", "dims", F.lit(True).alias("is_query"), every_block.alias("b"), part(sets, 2).alias("s"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        own = pdf[~pdf["is_query"]]
        if len(own):
            index = ImpactIndex(own["vec_id"].to_numpy(), np.stack(own["v"].to_numpy()))
            for q, v in zip(*(pdf.loc[pdf["is_query"], c] for c in ("vec_id", "v")), strict=True):
                out += [(q, i, score) for score, i in index.search(np.asarray(v), q, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = left.unionByName(right).groupBy("dims", "b", "s").applyInPandas(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
