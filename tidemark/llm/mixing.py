"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into blocks of at most BLOCK words.  A source's blocks are permuted by a hash; a source that
is wanted r times over is taken whole floor(r) times, and then as far down its permutation as its target
asks: up to a cut, the last block whose middle lies within the rest of the target.  The numbers of blocks so
drawn are the sources' quotas.  Which output shard gets how many of them is decided by counts alone: a node
of the tree holds exact quotas by source, and splits them in two by a multivariate-hypergeometric draw, as a
shuffle of all its blocks would; a leaf is a shard.  Each source's draws, in the order of its permutation,
then go to the shards in runs as long as their quotas - disjoint blocks, without a global shuffle - and each
shard is shuffled locally.

The tree and the targets are arithmetic on one row per source.  Cuts and ranks come from counts by hash
range, so that no task ever holds a whole source.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Workspace, light, unused

BLOCK = 256
#: blocks of one hash range, about, and words of one shard, about; a mix has LEAST_SHARDS at least
RANGE, SHARD_WORDS, LEAST_SHARDS = 50_000, 1 << 27, 16
#: draws of a source that look for their shard together
BIN = 1 << 16
#: rows that follow one another in a partition and lie in one bucket, a power of 2
LOT = 1 << 12
WEIGHTS = (5, 2, 1)


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Shares of `share` times all sizes by weight; a target stops at `most` times its source's size, and the
    excess is shared by weight among the others until none is above."""
    out = [0.0] * len(sizes)
    left, free = share * sum(sizes), [i for i in range(len(sizes)) if sizes[i] > 0]
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def _drawn(rng: np.random.Generator, have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """For each node (row of have: quotas by source) a multivariate-hypergeometric draw of `want` blocks, source by
    source; beyond the sampler's range by its normal limit."""
    took, left, want = np.zeros_like(have), have.sum(1), want.copy()
    for i in range(have.shape[1]):
        good, bad = have[:, i], left - have[:, i]
        n = np.zeros(len(have), np.int64)
        small = (good < 10**9) & (bad < 10**9)
        n[small] = rng.hypergeometric(good[small], bad[small], want[small])
        if not small.all():
            g, b, w = (x[~small].astype(float) for x in (good, bad, want))
            mean = w * g / (g + b)
            spread = np.sqrt(mean * (b / (g + b)) * ((g + b - w) / np.maximum(1, g + b - 1)))
            whole = np.rint(mean + spread * rng.standard_normal(len(g))).astype(np.int64)
            n[~small] = np.clip(whole, np.maximum(0, want[~small] - bad[~small]), np.minimum(good[~small], want[~small]))
        took[:, i] = n
        want -= n
        left = bad
    return took


def split(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Exact quotas of each of `shards` shards (rows) by source (columns), level by level of the tree."""
    rng = np.random.Generator(np.random.PCG64(seed))
    leaves, have = np.array([shards], np.int64), np.array([quotas], np.int64).reshape(1, len(quotas))
    while (leaves > 1).any():
        half = leaves // 2
        total = have.sum(1)
        # total * half // leaves, without a product beyond 64 bits
        one = _drawn(rng, have, total // leaves * half + total % leaves * half // leaves)
        leaves, have = np.stack([half, leaves - half], 1).ravel(), np.stack([one, have - one], 1).reshape(2 * len(have), have.shape[1])
        leaves, have = leaves[leaves > 0], have[leaves > 0]
    return have


def inline(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of driver-side rows, as a literal."""
    return spark.sql(f"select inline(from_json(:rows, 'array<struct<{schema}>>'))", args={"rows": json.dumps(rows)})


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


class Mix:
    """The draws of a mix of docs (doc_id, text, source, ...).

    rows: rid, doc_id, source, size, and the further columns asked for, one row per row of docs; plan: one row
    per source; taken(): what the mix takes of each row; draws(): one row per drawn copy of a block with its
    shard and place; mixed(): the rows that are drawn, with their draws.  Everything follows from doc_id, source and size, so reruns agree.  Null and blank texts
    have size 0: they have no block and nothing is taken of them.  A null source is a source of its own,
    after all others.  A null doc_id is one more id; rows that repeat a doc_id are rows of their own, told
    apart where their sizes or sources differ.  Further columns named like one of a result give way to it.
    An empty table gives an empty mix.
    """

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 0, extra: list[str] | None = None):
        self.spark, self.seed = docs.sparkSession, seed
        self.ws = ws = Workspace(self.spark, "mix")
        own = [c for c in extra or [] if c.lower() not in {"rid", "doc_id", "source", "size", "source_size", "target", "taken", "n_draws", "first_shard", "draws"}]
        rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("source").cast("string").alias("source"), _size(F.col("text")).alias("size"), *own)
        self.lots: DataFrame | None = None
        if own:  # in buckets of lots, so that mixed() needn't shuffle texts
            (self.lot,) = unused(rows, "lot")
            self.buckets = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
            self.lots = ws.keep(rows.withColumn(self.lot, self._lot()), self.lot, self.buckets)
            self.rows = self.lots.drop(self.lot)
        else:
            self.rows = ws.keep(rows)
        self.n_blocks = F.ceil(F.col("size") / BLOCK)
        # one row per source: sources are categories, however many documents they hold
        found = self.rows.groupBy("source").agg(F.sum("size").alias("size"), F.sum(self.n_blocks).alias("blocks")).collect()
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        self.sources, self.sizes = [r["source"] for r in found], [r["size"] for r in found]
        self.targets = targets(self.sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
        passes = [int(t // s) if s else 0 for t, s in zip(self.targets, self.sizes)]
        self.counts = [int(r["blocks"]) for r in found]
        self.ranges = max(1, -(-sum(self.counts) // RANGE))
        rest = [t - p * z for p, t, z in zip(passes, self.targets, self.sizes)]
        self._cuts(passes, rest)

    @staticmethod
    def _lot() -> Column:
        """Row numbers of a partition follow one another, from 0 in their lower 33 bits."""
        return F.shiftright("rid", LOT.bit_length() - 1)

    def _key(self, block: Column) -> Column:
        return F.xxhash64(F.lit(self.seed), "doc_id", block, "size")

    def _range(self, key: Column) -> Column:
        return F.floor((F.shiftrightunsigned(key, 1) / float(1 << 63)) * self.ranges).cast("int")

    def _words(self, block: Column) -> Column:
        return F.least(F.lit(BLOCK), F.col("size") - block * BLOCK)

    def _blocks(self, rows: DataFrame) -> DataFrame:
        """The blocks of sized rows: the columns of rows, block, words, key, range."""
        out = rows.where("size > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), self.n_blocks - 1)).alias("block"))
        out = out.withColumns({"words": self._words(F.col("block")), "key": self._key(F.col("block"))})
        return out.withColumn("range", self._range(F.col("key")))

    def _cuts(self, passes: list[int], rest: list[float]) -> None:
        """Sets plan (p_source, source_size, target, passes, c_range and cut, the place of the last block of the last
        pass) and quotas, the blocks that are drawn of each source."""
        ws, slim = self.ws, self.rows.select("rid", "doc_id", "source", "size")
        sums = self._blocks(slim).groupBy("source", "range").agg(F.sum("words").alias("w"), F.count("*").alias("b"))
        before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        #: words and blocks of a source before each hash range
        self.sums = ws.keep(sums.select("source", "range", "w", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("words_before"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("blocks_before")))
        wanted = [{"s": s, "rest": float(r)} for s, r in zip(self.sources, rest)]
        wanted = light(inline(self.spark, wanted, "s:string,rest:double"), len(wanted))
        # the range that holds the cut: those before it are taken whole, those after it not at all
        edges = self.sums.join(wanted, F.col("source").eqNullSafe(F.col("s"))).where("words_before < rest").groupBy("s").agg(F.max_by(F.struct("range", "words_before", "blocks_before", "rest"), "range").alias("e"))
        edges = ws.keep(edges.select("s", F.col("e.range").alias("e_range"), "e.words_before", "e.blocks_before", "e.rest"))
        inside = self._blocks(slim).join(light(edges), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("e_range")))
        w = Window.partitionBy("source").orderBy("key", "rid", "block").rowsBetween(Window.unboundedPreceding, 0)
        inside = inside.withColumn("middle", F.col("words_before") + F.sum("words").over(w) - F.col("words") / 2).where("middle < rest")
        inside = inside.groupBy("source").agg(F.max(F.struct("key", "rid", "block")).alias("cut"), F.count("*").alias("n"))
        last = {r["s"]: r for r in edges.join(inside.withColumnRenamed("source", "i_source"), F.col("s").eqNullSafe(F.col("i_source")), "left").collect()}
        plan, self.quotas = [], []
        for s, z, t, p, n in zip(self.sources, self.sizes, self.targets, passes, self.counts):
            e = last.get(s)
            cut = e["cut"] if e and e["cut"] else None
            plan.append({"p_source": s, "source_size": z, "target": t, "passes": p, "c_range": e["e_range"] if e else -1, "cut": {k: cut[k] for k in ("key", "rid", "block")} if cut else None})
            self.quotas.append(p * n + (int(e["blocks_before"]) + int(e["n"] or 0) if e else 0))
        self.plan = light(inline(self.spark, plan, "p_source:string,source_size:long,target:double,passes:int,c_range:int,cut:struct<key:long,rid:long,block:long>"), len(plan))

    def _copies(self, block: Column, key: Column) -> Column:
        """How often a block is taken; of rows joined with plan."""
        at = self._range(key)
        inside = (at == F.col("c_range")) & (F.struct(key.alias("key"), F.col("rid").alias("rid"), block.alias("block")) <= F.col("cut"))
        return F.col("passes") + ((at < F.col("c_range")) | F.coalesce(inside, F.lit(False))).cast("int")

    def taken(self) -> DataFrame:
        """rows with source_size, target, taken (words of all draws) and n_draws, each from the row and its source's cut:
        nothing is shuffled."""
        out = self.rows.join(self.plan, F.col("source").eqNullSafe(F.col("p_source")))
        blocks = F.when(F.col("size") > 0, F.sequence(F.lit(0).cast("long"), self.n_blocks - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
        copies = F.transform(blocks, lambda b: F.struct(self._copies(b, self._key(b)).alias("n"), self._words(b).alias("w")))
        out = out.withColumn("draws_of_blocks", copies)
        total = lambda f: F.aggregate("draws_of_blocks", F.lit(0).cast("long"), f)
        out = out.withColumns({"taken": total(lambda t, x: t + x["n"] * x["w"]), "n_draws": total(lambda t, x: t + x["n"])})
        return out.drop("p_source", "passes", "c_range", "cut", "draws_of_blocks")

    def drawn(self, shards: int | None = None) -> DataFrame:
        """rows with source_size, target, taken (words of all draws), n_draws and first_shard (null: none), gathered from
        the shards' draws."""
        took = self.draws(shards).groupBy("rid").agg(F.sum("words").alias("taken"), F.count("*").alias("n_draws"), F.min("shard").alias("first_shard"))
        out = self.rows.join(took, "rid", "left").join(self.plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source", "passes", "c_range", "cut")
        return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("taken", "n_draws")})

    def mixed(self, shards: int | None = None) -> DataFrame:
        """rows that a draw falls on, with source_size, target, taken (words of all draws), n_draws and draws: shard,
        position, block and pass of each.  Only here, after all draws are placed, do further columns take part; they
        are never shuffled: draws that can't be broadcast go to the bucket of their row."""
        draws = self.draws(shards).select("rid", "words", F.struct("shard", "position", "block", "pass").alias("draw"))
        gathered = F.sum("words").alias("taken"), F.count("draw").alias("n_draws"), F.array_sort(F.collect_list("draw")).alias("draws")
        if sum(self.quotas) <= BROADCAST_ROWS or self.lots is None:
            out = self.rows.join(light(draws.groupBy("rid").agg(*gathered), sum(self.quotas)), "rid")
        else:
            # an array of all rows of a lot in their order, drawn or not, so that each finds its own by its number
            lot, slots = unused(self.lots, "d_lot", "d_slots")
            every = draws.unionByName(self.rows.select("rid"), allowMissingColumns=True).withColumn(lot, self._lot()).repartition(self.buckets, lot)
            found = every.groupBy(lot, "rid").agg(*gathered).groupBy(lot).agg(F.sort_array(F.collect_list(F.struct("rid", "taken", "n_draws", "draws"))).alias(slots))
            # Spark leaves a bucketed table where it is only if the join has no key beside that of the buckets
            out = self.lots.join(found.hint("shuffle_hash"), F.col(self.lot) == F.col(lot))
            slot = F.col(slots)[F.col("rid").bitwiseAND(F.lit(LOT - 1)).cast("int")]
            out = out.select(*self.rows.columns, *[slot[c].alias(c) for c in ("taken", "n_draws", "draws")]).where("n_draws > 0")
        return out.join(self.plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source", "passes", "c_range", "cut")

    def draws(self, shards: int | None = None) -> DataFrame:
        """One row per drawn block: rid, source, block, words, pass, shard, position in the shard (from 0)."""
        shards = shards or max(LEAST_SHARDS, -(-int(sum(self.targets)) // SHARD_WORDS))
        ends = np.cumsum(split(self.quotas, shards, self.seed), 0)
        # a row per source and shard: low <= draw < high; joined by the bins of draws that a run meets
        runs = [{"r_source": s, "total": n, "ends": ends[:, i].tolist()} for i, (s, n) in enumerate(zip(self.sources, self.counts))]
        runs = inline(self.spark, runs, "r_source:string,total:long,ends:array<long>").select("r_source", F.posexplode("ends").alias("shard", "high"), F.expr("concat(array(0L), ends)").alias("lows"))
        runs = runs.select("r_source", "shard", F.col("lows")[F.col("shard")].alias("low"), "high").where("low < high")
        runs = runs.select("*", F.explode(F.expr(f"sequence(low div {BIN}, (high - 1) div {BIN})")).alias("r_bin"))
        n_runs = len(self.sources) * shards + sum(self.quotas) // BIN + 1
        totals = light(inline(self.spark, [{"t_source": s, "total": n} for s, n in zip(self.sources, self.counts)], "t_source:string,total:long"), len(self.sources))

        blocks = self._blocks(self.rows.select("rid", "doc_id", "source", "size")).join(self.plan, F.col("source").eqNullSafe(F.col("p_source")))
        blocks = blocks.select("rid", "source", "block", "words", "key", "range", self._copies(F.col("block"), F.col("key")).alias("copies")).where("copies > 0")
        # what is drawn of a range comes first in it, so that ranks among the drawn are ranks among all
        within = Window.partitionBy("source", "range").orderBy("key", "rid", "block")
        before = self.sums.select(F.col("source").alias("b_source"), F.col("range").alias("b_range"), "blocks_before")
        ranked = blocks.withColumn("n", F.row_number().over(within)).join(before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("range") == F.col("b_range")))
        ranked = ranked.join(totals, F.col("source").eqNullSafe(F.col("t_source"))).select("rid", "source", "block", "words", (F.col("blocks_before") + F.col("n") - 1).alias("place"), "total", F.explode(F.expr("sequence(0, copies - 1)")).alias("pass"))
        copies = ranked.withColumn("draw", F.col("pass") * F.col("total") + F.col("place")).withColumn("bin", F.expr(f"draw div {BIN}"))
        placed = copies.join(light(runs, n_runs), F.col("source").eqNullSafe(F.col("r_source")) & (F.col("bin") == F.col("r_bin")) & (F.col("draw") >= F.col("low")) & (F.col("draw") < F.col("high")))
        local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(self.seed + 1), "shard", "source", "draw"), "source", "draw")
        return placed.select("rid", "source", "block", "words", "pass", "shard", (F.row_number().over(local) - 1).alias("position"))
