"""A corpus pipeline: each stage takes the documents that the one before kept.

Every stage is one operator of tidemark.llm over its whole input; its result is written as Parquet and read
again as the next stage's documents.  All but the last return the columns of documents.

In every stage a row is told by its doc_id and its text: rows that share a doc_id but not the text are
judged each, and rows that are equal in both meet one fate.  Null texts and doc_ids, empty texts and empty
tables are allowed; further columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, linededup, minhash, mixing
from tidemark.llm.common import Workspace, light, table, unused


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: null texts and those without letters, and scores below the
    calibrated bound.  Without a labelled document there is no language to tell, and all go."""
    model = langid.train(docs.where(~langid.held_out()))
    rows = langid.predict(docs, model, *[F.col(c).alias(f"x_{c}") for c in docs.columns])
    return rows.where("not rejected").select(*[F.col(f"x_{c}").alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; a document all of whose lines went goes with them.  n_chars follows the
    text.  A row without a doc_id or a text stays as it is."""
    rows = linededup.line_dedup(docs)
    kept = rows.where("n_removed = 0 or n_removed < n_lines")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id (null too) and text are those of gone (doc_id, hash)."""
    owner, name = unused(docs, "owner", "hash")
    gone = light(gone.select(F.col("doc_id").alias(owner), F.col("hash").alias(name)).distinct())
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(owner)) & (F.xxhash64("text") == F.col(name)), "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row stays that comes first by doc_id and hash of the text, once if it is
    repeated.  Rows without a doc_id or without words stay; equal rows without words stay once too."""
    ws = Workspace(spark, "neardedup")
    found = ws.keep(minhash.near_duplicates(docs.select("doc_id", "text"), rows=True, ws=ws))
    ws.only(found)
    kept = _without(docs, found.where("doc_id is not null and not first"))
    repeated = ws.keep(found.where("doc_id is not null and first").groupBy("doc_id", "hash").count().where("count > 1").select("doc_id", "hash"))
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    owner, name = unused(docs, "owner", "hash")
    again = light(repeated.select(F.col("doc_id").alias(owner), F.col("hash").alias(name)))
    once = kept.join(again, (F.col("doc_id") == F.col(owner)) & (F.xxhash64("text") == F.col(name)), "left_semi").dropDuplicates(["doc_id", "text"])
    return _without(kept, repeated).unionByName(once).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, with or without a doc_id; the others stay as they are."""
    ws = Workspace(spark, "decontamination")
    found = ws.keep(decontaminate.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), hash=True, ws=ws))
    ws.only(found)
    return _without(docs, found.where("contaminated")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with size, source_size, target, taken (words, repeats counted),
    n_draws (blocks) and draws: the shard that the splitting tree gives each drawn block to, its position in the
    shuffled shard, block and pass.  Documents without words and those that no draw falls on are left out."""
    mix = mixing.Mix(docs, extra=[c for c in docs.columns if c not in ("doc_id", "source")])
    return mix.mixed().drop("rid")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: training, hashed signatures and permutations have no SQL; tests/llm/test_pipeline.py checks each stage
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = ws.keep(stage(spark, docs, sf_dir))
        ws.only(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
