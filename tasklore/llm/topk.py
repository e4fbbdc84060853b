"""Operator 4, exact top-k search by inner product with a vector-approximation file.

Vectors are whole numbers, floor(scale * x). Each dimension is cut into cells of equal width between the least and the largest value of the
table, and a vector is also kept as its cell numbers. For a block of queries, the cells alone bound every score from
above; exact vectors are then read in the order of those bounds until the k-th score is above all bounds left. Ties
go to the smaller id, so equal bounds are still read.

Queries and candidates meet in blocks of bounded size; every (query block, candidate block) gives its k best, and those are merged.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; vectors of different length are never
compared; candidates with the query's own id are left out, so are repeated rows of it; other repeated rows each count; a
query id given twice is asked once for each length, with the least of its vectors. Scores are exact while they stay below 2 ** 53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklore.llm.common import written

CELL_BITS = 5
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 4096
READ_AT_ONCE = 64


def whole_vectors(embeddings: DataFrame, scale: int) -> DataFrame:
    """``vec_id``, ``size`` and ``whole`` (floor(scale * x) as double) of the vectors that take part."""
    usable = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embeddings.filter(usable).select(
        "vec_id", F.size("embedding").alias("size"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("whole"))


def cells(whole: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For every vector length: the lowest value and the cell width of each dimension, over all rows.

    The driver gets two numbers a dimension.
    """
    spread = whole.select("size", F.posexplode("whole").alias("dimension", "value")).groupBy("size", "dimension").agg(
        F.min("value").alias("low"), F.max("value").alias("high")).orderBy("size", "dimension").toPandas()
    return {int(size): (rows.low.to_numpy(), np.maximum(np.ceil((rows.high - rows.low + 1).to_numpy() / (1 << CELL_BITS)), 1))
            for size, rows in spread.groupby("size")}


def search(queries: np.ndarray, codes: np.ndarray, exact: np.ndarray, low: np.ndarray, width: np.ndarray,
           query_ids: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of each query's best k in one candidate block; rows of ``exact`` are read only as bounds ask."""
    half = (width - 1) / 2
    middle = low + codes * width + half
    bounds = queries @ middle.T + (np.abs(queries) @ half)[:, None]  # products of halves and whole numbers: exact in double
    out = []
    for row, query_id in enumerate(query_ids):
        others = np.flatnonzero(ids != query_id)
        own = bounds[row, others]
        best_scores, best_ids = np.zeros(0), np.zeros(0, np.int64)
        rest, ahead = np.arange(len(others)), READ_AT_ONCE
        done = False
        while len(rest) and not done:
            # The next candidates by bound, more of them each time. Each round splits what is left, so that rows with equal bounds are read once.
            if ahead < len(rest):
                split = np.argpartition(-own[rest], ahead - 1)
                near, rest = rest[split[:ahead]], rest[split[ahead:]]
            else:
                near, rest = rest, rest[:0]
            near = near[np.argsort(-own[near], kind="stable")]
            ahead *= 4
            for begin in range(0, len(near), READ_AT_ONCE):
                part = near[begin:begin + READ_AT_ONCE]
                if len(best_scores) == k and own[part[0]] < best_scores[-1]:
                    done = True
                    break
                places = others[part]
                best_scores = np.concatenate([best_scores, exact[places] @ queries[row]])
                best_ids = np.concatenate([best_ids, ids[places]])
                keep = np.lexsort((best_ids, -best_scores))[:k]
                best_scores, best_ids = best_scores[keep], best_ids[keep]
        out += [(int(query_id), int(vec_id), int(score)) for vec_id, score in zip(best_ids, best_scores, strict=True)]
    return out


def top_k(embeddings: DataFrame, query_divisor: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of every row whose id is divisible by ``query_divisor``."""
    whole = written(whole_vectors(embeddings, scale), "whole-vectors")
    grid = cells(whole)
    asked = whole.filter((F.col("vec_id") % query_divisor == 0)).groupBy("vec_id", "size").agg(F.min("whole").alias("whole"))
    asked_rows, rows = whole.filter(F.col("vec_id") % query_divisor == 0).count(), whole.count()
    query_blocks, blocks = max(1, -(-asked_rows // QUERY_BLOCK)), max(1, -(-rows // CANDIDATE_BLOCK))
    # Queries are the smaller side: each is sent to every candidate block, each candidate to every query block it must meet.
    left = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("query_block"),
                        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "size", "vec_id", "whole")
    right = whole.select(F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"),
                         F.pmod(F.xxhash64("vec_id", "whole"), F.lit(blocks)).cast("int").alias("block"), "size", "vec_id", "whole")

    def meet(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if queries.empty or candidates.empty:
            return pd.DataFrame({name: pd.Series(dtype="int64") for name in columns})
        low, width = grid[int(queries["size"].iloc[0])]
        exact = np.stack(candidates["whole"].to_numpy())
        codes = ((exact - low) // width).astype(np.uint8)
        ids = candidates["vec_id"].to_numpy(np.int64)
        return pd.DataFrame(search(np.stack(queries["whole"].to_numpy()), codes, exact, low, width, queries["vec_id"].to_numpy(np.int64), ids, k),
                            columns=columns)

    keys = ["query_block", "block", "size"]
    found = left.filter("size > 0 and vec_id is not null").groupBy(*keys).cogroup(right.filter("size > 0 and vec_id is not null").groupBy(*keys)).applyInPandas(
        meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
