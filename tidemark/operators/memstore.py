"""The rules of a sorted map with tombstones, applied to a whole log of operations at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPS = ("ADD", "UPSERT", "DELETE", "DELETE_IF_EXISTS", "TOMBSTONE")


def judged(log: DataFrame, key: str = "key") -> DataFrame:
    """log (seq, op, key, value) -> log with effect (PUT, DEL or null: none) and error (null: none).

    ADD fails on a live key (KEY_EXISTS) but not on a tombstoned one; DELETE fails on a key never inserted
    (KEY_NOT_FOUND), DELETE_IF_EXISTS does nothing there; a null key or value to insert fails (KEY_NULL,
    VALUE_NULL).  What an operation does depends only on whether the key is absent, live or dead before it.  A
    window over the key's operations finds that: the last one before that decides the state whatever came
    before it (a valid UPSERT or ADD leaves it live; a TOMBSTONE leaves it dead; deletes leave it dead if any
    insertion came before).
    """
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    put = F.col("op").isin("ADD", "UPSERT") & F.col("value").isNotNull() & F.col(key).isNotNull()
    inserted = put | (F.col("op") == "TOMBSTONE")
    known = F.coalesce(F.max(inserted.cast("int")).over(w), F.lit(0)) == 1
    last = F.last(F.when(put, True).when(F.col("op").isin(*OPS[2:]), False), True).over(w)
    live = known & F.coalesce(last, F.lit(False))
    error = (
        F.when(F.col(key).isNull(), "KEY_NULL")
        .when(F.col("op").isin("ADD", "UPSERT") & F.col("value").isNull(), "VALUE_NULL")
        .when((F.col("op") == "ADD") & live, "KEY_EXISTS")
        .when((F.col("op") == "DELETE") & ~known, "KEY_NOT_FOUND")
    )
    effect = F.when(F.col("error").isNull() & F.col("op").isin("ADD", "UPSERT"), "PUT").when(F.col("error").isNull() & ((F.col("op") == "TOMBSTONE") | F.col("op").isin("DELETE", "DELETE_IF_EXISTS") & F.col("known")), "DEL")
    return log.withColumns({"error": error, "known": known}).withColumn("effect", effect).drop("known")


def state(log: DataFrame, key: str = "key") -> DataFrame:
    """key, value (null: tombstone) after the whole log."""
    done = judged(log, key).where("effect is not null").withColumn("value", F.when(F.col("effect") == "PUT", F.col("value")))
    return done.groupBy(key).agg(F.max_by(F.struct("value"), "seq").alias("r")).select(key, F.col("r.value").alias("value"))


def flush(state_: DataFrame, tombstones: bool = False) -> DataFrame:
    return state_ if tombstones else state_.where(F.col("value").isNotNull())


def size(state_: DataFrame, key: str = "key") -> DataFrame:
    return state_.agg(F.count_distinct(key).alias("size"))


def estimate(bytes_: Column) -> Column:
    """The estimated footprint of so many bytes of keys and values."""
    return F.floor(F.lit(1.15).cast("float") * bytes_.cast("float")).cast("long")


def estimated_size(state_: DataFrame, key: str = "key") -> DataFrame:
    total = F.coalesce(F.sum(F.octet_length(key) + F.coalesce(F.octet_length("value"), F.lit(0))), F.lit(0))
    return state_.agg(estimate(total).alias("estimated_bytes"))


def rw_contains(write_store: DataFrame, read_store: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """keys with `either` (live in one of the stores, whatever the other says) and `live` (the write store decides)."""
    w = write_store.select(key, F.lit(True).alias("w"), F.col("value").isNotNull().alias("wl"))
    r = read_store.select(key, F.col("value").isNotNull().alias("rl"))
    out = keys.join(w, key, "left").join(r, key, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.select(key, (yes("wl") | yes("rl")).alias("either"), F.when(yes("w"), yes("wl")).otherwise(yes("rl")).alias("live"))
