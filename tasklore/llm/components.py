"""Connected components of a link table, as joins and aggregations over written tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklore.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links`` (left_node, right_node): the smallest node it can reach.

    Alternates two star contractions until nothing changes: larger neighbours move to the smallest neighbour, then smaller ones do.
    Each round aggregates minima (combined before the shuffle) and joins them back; a node with most links is a skewed join
    key, which adaptive execution splits. The number of rounds grows with the logarithm of the longest chain.
    """
    low, high = F.least("left_node", "right_node"), F.greatest("left_node", "right_node")
    pairs = written(links.filter("left_node <> right_node").select(high.alias("upper"), low.alias("lower")).distinct(), "links")
    state = None
    while True:
        both = pairs.union(pairs.select("lower", "upper"))
        pairs = written(_contract(both, F.col("lower") > F.col("upper")), "large-star")
        pairs = written(_contract(pairs, F.lit(True), own=True), "small-star")
        found = pairs.agg(F.count("*"), F.sum(F.xxhash64("upper", "lower").cast("decimal(38,0)"))).first()
        if found == state:
            return pairs.select(F.col("upper").alias("node"), F.col("lower").alias("component")).union(
                pairs.select(F.col("lower"), F.col("lower")).distinct())
        state = found


def _contract(pairs: DataFrame, moved, own: bool = False) -> DataFrame:
    """Link every neighbour ``lower`` of ``upper`` that is to move with the smallest node around ``upper``."""
    least = pairs.groupBy("upper").agg(F.least(F.min("lower"), F.first("upper")).alias("least"))
    near = pairs.join(least, "upper")
    out = near.filter(moved).select(F.col("lower").alias("upper"), F.col("least").alias("lower"))
    if own:
        out = out.union(least.select("upper", F.col("least").alias("lower")))
    return out.filter(F.col("upper") != F.col("lower")).distinct()


def merge(parents: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Union links (positions) into a fully compressed parent array; roots are the smallest positions."""
    while len(left):
        first, second = parents[left], parents[right]
        apart = first != second
        if not apart.any():
            return
        left, right = left[apart], right[apart]
        np.minimum.at(parents, np.maximum(first, second)[apart], np.minimum(first, second)[apart])
        while not np.array_equal(above := parents[parents], parents):
            parents[:] = above
