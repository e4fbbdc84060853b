"""Measured join sides: broadcast only what is known to be small, and have another way beyond that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

from tasklore.session import scratch_path

MAX_BROADCAST_BYTES = 256 * 1024 * 1024


def _width(value: Column, kind: DataType) -> Column:
    """About the bytes of a value in memory, with what nested values hold."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint") + 16
    if isinstance(kind, StructType):
        return sum((_width(value[part.name], part.dataType) for part in kind.fields), F.lit(16).cast("bigint"))
    if isinstance(kind, ArrayType):
        held = F.aggregate(value, F.lit(0).cast("bigint"), lambda total, item: total + _width(item, kind.elementType))
        return F.coalesce(held, F.lit(0)) + 16
    if isinstance(kind, MapType):
        return _width(F.map_keys(value), ArrayType(kind.keyType)) + _width(F.map_values(value), ArrayType(kind.valueType))
    return F.lit(16).cast("bigint")


def measured(rows: DataFrame, name: str, max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Write a key-sized table once to the shared folder; return it and whether it is small enough to broadcast.

    Planning the join with the big side only after the small side's size is known keeps the big side from
    being shuffled for nothing: adaptive execution would learn the size while that shuffle already runs.
    The written table also cuts the lineage, so a lost executor does not recompute the keys.
    """
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    kept = rows.sparkSession.read.schema(rows.schema).parquet(path)
    width = sum((_width(F.col(part.name), part.dataType) for part in rows.schema.fields), F.lit(0))
    size = kept.agg(F.sum(width)).first()[0] or 0
    return kept, size <= max_bytes


def join_measured(big: DataFrame, keys: DataFrame, on: list[str], name: str,
                  max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Inner join of a big table with a key table: broadcast keys when they are small, else a shuffled join."""
    if keys.isStreaming or big.isStreaming:
        return big.join(keys, on)
    kept, small = measured(keys, name, max_bytes)
    return big.join(F.broadcast(kept) if small else kept, on)
