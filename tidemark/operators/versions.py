"""Versions of keys: keep-latest, tombstones, and merges with reducers.

A versioned relation has a key, a value (null: a tombstone) and a number, gen or seq, that grows with time.
All reductions are aggregates, so Spark combines them before the shuffle; none drops a tombstone before the
latest version is known.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, by: str = "gen", key: str = "key") -> DataFrame:
    """One row per key: the one with the greatest `by`, tombstones included."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def live(df: DataFrame, by: str = "gen", key: str = "key", drop_empty: bool = False) -> DataFrame:
    """The latest versions that aren't tombstones; with drop_empty, empty values count as tombstones too."""
    out = keep_latest(df, by, key).where(F.col("value").isNotNull())
    return out.where(F.length("value") > 0) if drop_empty else out


def stack(tables: list[DataFrame], start: int = 0) -> DataFrame:
    """Tables from oldest to newest as one versioned relation: gen is a table's ordinal."""
    return reduce(DataFrame.unionByName, [t.withColumn("gen", F.lit(start + i).cast("long")) for i, t in enumerate(tables)])


def from_mutations(log: DataFrame, key: str = "key") -> DataFrame:
    """MUTATION rows as versions: a DEL has no value."""
    return log.select(key, F.when(F.col("op") == "PUT", F.col("value")).alias("value"), F.col("seq"))


def merge_ordered(tables: list[DataFrame]) -> DataFrame:
    """All versions of all tables in the order of keys, ties by table; duplicates stay."""
    return stack(tables).orderBy("key", "gen")


def merge_disjoint(tables: list[DataFrame]) -> DataFrame:
    """The union of tables; a key in more than one is an error when the result is read."""
    rows = stack(tables).groupBy("key").agg(F.count("*").alias("n"), F.min_by(F.struct("value"), "gen").alias("v"))
    clash = F.raise_error(F.lit("the same key stands in more than one table"))
    return rows.select("key", F.when(F.col("n") == 1, F.col("v.value")).otherwise(clash).alias("value"))


def latest_wins(by: str = "gen") -> Column:
    return F.max_by(F.struct("value"), by)["value"]


def first_wins(by: str = "gen") -> Column:
    return F.min_by(F.struct("value"), by)["value"]


def joined_values(separator: str, by: str = "gen") -> Column:
    """Values that aren't null, from oldest to newest, joined."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(by), F.col("value"))))
    return F.array_join(F.transform(pairs, lambda p: p["value"]), separator)


def merge_compact(df: DataFrame, reducer: Column, key: str = "key", empty_is_null: bool = False) -> DataFrame:
    """One row per key with an aggregate over its versions; keys whose result is null go."""
    out = df.groupBy(key).agg(reducer.alias("value")).where(F.col(key).isNotNull() & F.col("value").isNotNull())
    return out.where(F.length("value") > 0) if empty_is_null else out


def merge_compact_python(df: DataFrame, reduce_: Callable, schema: str = "key binary, value binary") -> DataFrame:
    """Any Python reducer of (key, values, gens) -> (key, value), both lists from oldest to newest; it may rename the
    key; a null key or value drops the row.  One key's versions must fit a task; prefer merge_compact."""

    def apply(pdf):
        import pandas as pd

        pdf = pdf.sort_values("gen")
        key, value = reduce_(pdf["key"].iloc[0], list(pdf["value"]), list(pdf["gen"]))
        return pd.DataFrame({"key": [key], "value": [value]} if key is not None and value is not None else {"key": [], "value": []}, dtype=object)

    return df.select("key", "value", "gen").groupBy("key").applyInPandas(apply, schema)


def sequenced(df: DataFrame, *order: str, bins: int = 128) -> DataFrame:
    """seq from 1 in the order given: rows are ranked within bins of the order, and the bins' counts shift the ranks.

    Bins lie between quantiles of a sample of `20 * bins` rows, which decides nothing but where they begin.  The
    bounds are values, so that both passes over df put a row into the same bin, however Spark splits or merges
    partitions.  Rows that tie in all of the order take any of their places, once each; nulls come first.
    """
    from pyspark.sql import Window

    kinds = [f.dataType for f in df.select(*order).schema]
    sample = df.select(*order).orderBy(F.xxhash64(*order)).limit(20 * bins).distinct().orderBy(*order).collect()
    ends = [F.struct(*[F.lit(v).cast(t).alias(c) for c, v, t in zip(order, r, kinds)]) for r in sample[:: max(1, len(sample) // bins)]]
    at = F.size(F.filter(F.array(*ends), lambda end: end <= F.struct(*order))) if ends else F.lit(0)
    binned = df.withColumn("__bin", at)
    before = binned.groupBy("__bin").count().select("__bin", F.coalesce(F.sum("count").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = binned.withColumn("__n", F.row_number().over(Window.partitionBy("__bin").orderBy(*order)))
    return ranked.join(F.broadcast(before), "__bin").withColumn("seq", F.col("__before") + F.col("__n")).drop("__bin", "__n", "__before")
