"""Scans and lookups over key-value relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import check_bounds
from .versions import keep_latest

FOUND, NOT_FOUND, TOMBSTONED = "FOUND", "NOT_FOUND", "TOMBSTONED"


def scan(df: DataFrame, key: str = "key") -> DataFrame:
    return df.orderBy(key)


def scan_from(df: DataFrame, low, key: str = "key") -> DataFrame:
    """Rows from a key on, in order."""
    return df.where(F.col(key) >= F.lit(low)).orderBy(key)


def scan_range(df: DataFrame, low, high, key: str = "key") -> DataFrame:
    """Rows between two keys, both included, in order; reversed bounds are an error."""
    check_bounds(low, high)
    return df.where(F.col(key).between(F.lit(low), F.lit(high))).orderBy(key)


def get(df: DataFrame, wanted, key: str = "key") -> DataFrame:
    return df.where(F.col(key) == F.lit(wanted))


def with_status(latest: DataFrame, key: str = "key") -> DataFrame:
    """key, status, value of the latest versions: FOUND or TOMBSTONED."""
    return latest.select(key, F.when(F.col("value").isNull(), TOMBSTONED).otherwise(FOUND).alias("status"), "value")


def get_many(versions: DataFrame, keys: DataFrame, by: str = "gen", key: str = "key", empty_is_missing: bool = False) -> DataFrame:
    """One row per row of keys: key, status, value.  Only versions of wanted keys are reduced."""
    latest = keep_latest(versions.join(keys.select(key).distinct(), key, "left_semi").select(key, "value", by), by, key)
    out = keys.select(key).join(latest.select(key, "value", F.lit(True).alias("known")), key, "left")
    status = F.when(F.col("known").isNull(), NOT_FOUND).when(F.col("value").isNull(), TOMBSTONED).otherwise(FOUND)
    if empty_is_missing:
        status = F.when(F.length("value") == 0, NOT_FOUND).otherwise(status)
    return out.select(key, status.alias("status"), F.when(status == FOUND, F.col("value")).alias("value"))


def contains_many(versions: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The keys that any version holds, tombstoned or not."""
    return keys.join(versions.select(key), key, "left_semi")


def missing(versions: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return keys.join(versions.select(key), key, "left_anti")


def layered(tables: DataFrame, read_store: DataFrame, write_store: DataFrame, key: str = "key") -> DataFrame:
    """Tables (key, value, gen) under a read store under a write store, as one versioned relation."""
    top = tables.agg(F.coalesce(F.max("gen"), F.lit(-1)).alias("top"))
    stores = read_store.select(key, "value", F.lit(1).alias("up")).unionByName(write_store.select(key, "value", F.lit(2).alias("up")))
    return tables.select(key, "value", "gen").unionByName(stores.crossJoin(F.broadcast(top)).select(key, "value", (F.col("top") + F.col("up")).alias("gen")))
