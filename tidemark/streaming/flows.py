"""Incremental maintenance of a store and of the latest state from a stream of mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..plans.store import Store


def flush_stream(mutations: DataFrame, store: Store, checkpoint: str, compact: bool = False) -> DataStreamWriter:
    """Each micro-batch of (seq, op, key, value) becomes a generation; a batch that is retried is written once."""

    def flush(batch: DataFrame, number: int) -> None:
        store.flush(batch, number)
        if compact:
            store.compact()

    return mutations.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)


def latest_stream(mutations: DataFrame) -> DataFrame:
    """key, value (null: tombstone), seq as a streaming aggregate, for update or complete mode.  Late rows need no
    watermark: the greatest seq wins whenever it arrives."""
    value = F.when(F.col("op") == "PUT", F.col("value"))
    return mutations.groupBy("key").agg(F.max_by(F.struct(value.alias("value")), "seq").alias("r"), F.max("seq").alias("seq")).select("key", F.col("r.value").alias("value"), "seq")
