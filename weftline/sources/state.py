"""Keyed tables with the operations of a key-value store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def get(store: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """keys with their values; `found` tells a missing key from a null value."""
    return keys.join(store.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def upsert(store: DataFrame, new: DataFrame, key: str = "key", order: str | None = None) -> DataFrame:
    """store with the rows of new in place of those of the same key.

    Of the rows of new with one key the last by `order` counts, which needn't be a column of store; without it the largest by all columns.
    """
    by = F.struct(*([order] if order else []), *(c for c in new.columns if c not in (key, order)))
    last = new.groupBy(key).agg(F.max(by).alias("__last")).select(key, *(F.col(f"__last.{c}").alias(c) for c in store.columns if c != key))
    return store.join(last.select(key), key, "left_anti").unionByName(last)


def delete(store: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return store.join(keys.select(key), key, "left_anti")
