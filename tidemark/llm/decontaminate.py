"""Benchmark decontamination by a prefix-filtered set join.

Items fall into windows of ten words (an item of fewer is one window).  A window's tokens are its shingles of
three words (fewer for shorter windows).  For containment of the whole window a prefix of one token is enough:
a text that holds the window holds its rarest shingle too.  One pass over the documents joins the shingles of
every position with those of all windows and writes the hits, each with the words around it; the hits give
each shingle's frequency over all documents, hence every window's rarest one.  Joining on those alone leaves
candidates with a start position, which must leave room for the window to both sides (positional and length
bounds); the words around the hit then verify exact containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

WINDOW, SHINGLE = 10, 3
#: window shingles that may be broadcast (some 100 bytes each); more are joined by shuffling
BROADCAST = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    r"""[^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z in lower case; null: none."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAPS), ""), F.expr("cast(array() as array<string>)"))


def _gram(array: str, at: str, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.expr(f"get({array}, {at} + {j})") for j in range(size)])


def windows(items: DataFrame) -> DataFrame:
    """items (item_id, text) -> (item_id string, window array<string>), each pair once."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.explode(F.expr(f"sequence(0, greatest(size(w) - {WINDOW}, 0))"))
    return w.select("item_id", "w", starts.alias("at")).select("item_id", F.slice("w", F.col("at") + 1, WINDOW).alias("window")).distinct()


def hits(ws: Workspace, docs: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """docs (doc_id, w, ...) and grams (gram, size) -> one row with size 0 per document, and one per position of a
    document at which a gram stands: rid (number of the document), doc_id and what else docs has, n_words, gram, size, at, and around,
    the words near the position."""
    docs = docs.withColumn("rid", F.monotonically_increasing_id())
    grams = grams.select("gram", F.lit(True).alias("known"))
    small = grams.count() <= BROADCAST
    if not small:
        docs = ws.keep(docs)
    carried = [c for c in docs.columns if c not in ("rid", "w")]
    spread = docs.select("rid", *carried, "w", F.explode(F.expr("sequence(-1, size(w) - 1)")).alias("at"))
    spread = spread.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("size")).where(f"at >= 0 or size = {sizes[0]}")
    gram = [F.when((F.col("size") == n) & (F.col("at") >= 0) & (F.col("at") <= F.size("w") - n), _gram("w", "at", n)) for n in sizes]
    spread = spread.withColumn("gram", F.coalesce(*gram))
    if small:
        spread = spread.join(F.broadcast(grams), "gram", "left").where("known or at = -1")
    else:  # the words stay behind until it is known which positions they are wanted at
        spread = spread.select("rid", "at", "size", "gram").join(grams, "gram", "left").where("known or at = -1").join(docs, "rid")
    return ws.keep(
        spread.select(
            "rid", *carried, F.size("w").alias("n_words"), "gram", F.when(F.col("at") >= 0, F.col("size")).otherwise(0).alias("size"), "at",
            F.when(F.col("at") >= 0, F.expr(f"slice(w, greatest(at - {WINDOW} + 1, 0) + 1, {2 * WINDOW})")).alias("around"),
        )
    )


def decontaminate(docs: DataFrame, items: DataFrame, hash: bool = False, ws: Workspace | None = None) -> DataFrame:  # noqa: A002
    """docs (doc_id, text, ...), items (item_id, text, ...) -> one row per row of docs: doc_id, n_words, n_hit,
    n_items, items_sha256, contaminated.

    A document word inside any occurrence of a window is hit; n_items counts items with an occurring window;
    items_sha256 is the hash of their ids, sorted as strings and joined by commas.  A null or empty text has
    no words; an item without words has no window; items that repeat count once by id, and an item without
    an id lends its windows to the hits but isn't counted.  Repeated documents are judged each; a null doc_id
    stays null; other columns are ignored; either table may be empty.  With hash, a column hash (xxhash64 of the
    text) tells rows of one doc_id apart.  The result reads tables in ws, or in a workspace of its own.
    """
    ws = ws or Workspace(docs.sparkSession, "decontaminate")
    pairs = ws.keep(windows(items))
    texts = ws.keep(pairs.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()).withColumn("n", F.size("window")).withColumn("size", F.least("n", F.lit(SHINGLE))))
    offsets = texts.select("wid", "window", "n", "size", F.explode(F.expr("sequence(0, n - size)")).alias("offset"))
    sizes = [r["size"] for r in texts.select("size").distinct().orderBy(F.desc("size")).collect()] or [SHINGLE]  # at most SHINGLE rows
    gram = None
    for size in sizes:
        this = F.when(F.col("size") == size, _gram("window", "offset", size))
        gram = this if gram is None else F.coalesce(gram, this)
    offsets = ws.keep(offsets.select("wid", "n", "window", "size", "offset", gram.alias("gram")))

    more = ["hash"] * hash
    docs = docs.select("doc_id", *[F.xxhash64("text").alias(c) for c in more], words(F.col("text")).alias("w"))
    found = hits(ws, docs, offsets.select("gram", "size").distinct(), sizes)
    rarity = found.where("size > 0").groupBy("gram").agg(F.count("*").alias("df"))
    # a shingle that no document holds makes its window impossible: df 0 comes first and joins nothing
    prefix = offsets.join(rarity, "gram", "left").groupBy("wid").agg(F.min_by(F.struct("gram", "offset", "n", "window"), F.struct(F.coalesce("df", F.lit(0)), "offset")).alias("p"))
    prefix = prefix.select("wid", "p.*")
    if texts.count() <= BROADCAST // 10:
        prefix = F.broadcast(prefix)
    start = F.col("at") - F.col("offset")
    candidates = found.join(prefix, "gram").withColumn("start", start)
    candidates = candidates.where("start >= 0 and start + n <= n_words")
    first = F.greatest(F.col("at") - WINDOW + 1, F.lit(0))
    whole = ws.keep(candidates.where(F.slice("around", start - first + 1, F.col("n")) == F.col("window")).select("rid", "wid", "start", "n"))

    covered = whole.select("rid", F.explode(F.expr("sequence(start, start + n - 1)")).alias("at")).distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    named = pairs.where("item_id is not null").join(texts.select("window", "wid"), "window").select("wid", "item_id")
    listed = whole.select("rid", "wid").distinct().join(named, "wid").groupBy("rid").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    listed = listed.select("rid", F.size("ids").cast("long").alias("n_items"), F.concat_ws(",", "ids").alias("ids"))
    out = found.where("size = 0").select("rid", "doc_id", *more, F.col("n_words").cast("long").alias("n_words")).join(covered, "rid", "left").join(listed, "rid", "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), *more)
