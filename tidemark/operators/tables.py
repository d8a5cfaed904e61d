"""Statistics of tables, and which of them to compact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def table_meta(df: DataFrame, key: str = "key") -> DataFrame:
    """Per gen: num_records, null_values, min_key, max_key, and bytes of values, keys and both."""
    data, index = F.sum(F.coalesce(F.octet_length("value"), F.lit(0))), F.sum(F.octet_length(key))
    return df.groupBy("gen").agg(
        F.count("*").alias("num_records"), F.count_if(F.col("value").isNull()).alias("null_values"), F.min(key).alias("min_key"), F.max(key).alias("max_key"),
        data.cast("long").alias("data_bytes"), index.cast("long").alias("index_bytes"), (data + index).cast("long").alias("total_bytes"),
    )


def super_meta(meta: DataFrame) -> DataFrame:
    """Sums over tables (keys in several tables count several times).  first_key is the greatest of the minima, as
    the stacked reader reports it; min_key is the true minimum."""
    return meta.agg(
        F.sum("num_records").alias("num_records"), F.max("min_key").alias("first_key"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"),
        F.sum("data_bytes").alias("data_bytes"), F.sum("index_bytes").alias("index_bytes"), F.sum("total_bytes").alias("total_bytes"),
    )


def base_path(paths: DataFrame) -> DataFrame:
    """The tables' paths from oldest to newest, joined by commas.  paths (gen, path) is a manifest: driver-sized."""
    return paths.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gen", "path"))), lambda p: p["path"]), ",").alias("base_path"))


def with_ratio(meta: DataFrame) -> DataFrame:
    ratio = F.when(F.col("num_records") > 0, (F.col("null_values").cast("float") / F.col("num_records").cast("float")).cast("float"))
    return meta.withColumn("tombstone_ratio", ratio)


def candidates(meta: DataFrame, max_bytes: int, ratio: float = 0.2) -> DataFrame:
    """meta with selected: smaller than max_bytes, or a share of tombstones of `ratio` at least."""
    if not 0 <= ratio <= 1:
        raise ValueError("the ratio must lie between 0 and 1")
    meta = with_ratio(meta)
    worn = F.coalesce(F.col("tombstone_ratio") >= F.lit(ratio).cast("float"), F.lit(False))
    return meta.withColumn("selected", (F.col("total_bytes") < max_bytes) | worn)


def flood_fill(chosen: DataFrame) -> DataFrame:
    """All tables between the first and the last selected one are selected, so that their order survives.
    chosen is a manifest with one row per table: driver-sized."""
    picked = F.when(F.col("selected"), F.col("gen"))
    everything = Window.partitionBy()
    return chosen.withColumn("filled", F.coalesce(F.col("gen").between(F.min(picked).over(everything), F.max(picked).over(everything)), F.lit(False)))


def compact(df: DataFrame, filled: DataFrame, threshold: int = 10, keep_tombstones: bool | None = None) -> DataFrame:
    """df (key, value, gen) with the filled tables merged into one that takes the oldest one's gen.

    Nothing happens unless more than `threshold` tables are filled.  Tombstones go only if the oldest table of
    all is among them, since an older one may still hold the key; keep_tombstones overrides that.
    """
    gens = sorted(r["gen"] for r in filled.where("filled").select("gen").collect())
    if len(gens) <= threshold:
        return df.select("key", "value", "gen")
    if keep_tombstones is None:
        keep_tombstones = filled.agg(F.min("gen")).first()[0] < gens[0]
    inside = F.col("gen").between(gens[0], gens[-1])
    merged = df.where(inside).groupBy("key").agg(F.max_by(F.struct("value"), "gen").alias("r")).select("key", F.col("r.value").alias("value"))
    if not keep_tombstones:
        merged = merged.where(F.length("value") > 0)
    return df.where(~inside).select("key", "value", "gen").unionByName(merged.withColumn("gen", F.lit(gens[0]).cast("long")))
