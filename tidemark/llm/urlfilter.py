"""URL filter lists by a cascade of Bloom filters.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest
rule wins.  The keys that could be a rule of some url in the corpus - each suffix of its host at a dot, with
each prefix of its path as long as some rule's path - form a complete universe.  Level 1 of a cascade is a
Bloom filter of the listed keys; each further level encodes the keys of the other side that the level before
it lets through by mistake, until none is left.  A key of the universe is listed if it passes an odd number
of levels before one refuses it or they end; no join is needed to ask, and the answer is exact for every key
of the universe.  A second cascade, over the rules, separates block from allow.

Level 1 is sized for fewer mistakes than there are listed keys, whatever the size of the universe.  So all
levels grow with the list, by the logarithm of the universe: some 4 bytes a rule for a thousand million keys.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, arrow_map

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _hashes(key: Column, level: int) -> Column:
    """Two 64-bit hashes of a key, of which a level makes all its own."""
    return F.array(F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key))


class Level:
    """A Bloom filter of `count` keys that lets a share of about `miss` of all others through."""

    def __init__(self, count: int, miss: float):
        self.k = max(1, math.ceil(-math.log2(miss)))
        self.bits = np.zeros(max(64, math.ceil(count * self.k / math.log(2))), bool)

    def spots(self, hashes: np.ndarray) -> np.ndarray:
        """keys x 2 hashes -> keys x k bit numbers."""
        h = hashes.astype(np.int64).view(np.uint64).reshape(-1, 2)
        return (h[:, :1] + np.arange(self.k, dtype=np.uint64) * (h[:, 1:] | np.uint64(1))) % np.uint64(len(self.bits))

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        return self.bits[self.spots(hashes)].all(1)

    def __getstate__(self):
        return {"k": self.k, "n": len(self.bits), "packed": np.packbits(self.bits)}

    def __setstate__(self, state):
        self.k, self.bits = state["k"], np.unpackbits(state["packed"], count=state["n"]).astype(bool)


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def hashes(self, key: Column) -> Column:
        """The hashes of a key for all levels."""
        return F.flatten(F.array(*[_hashes(key, i) for i in range(len(self.levels))])) if self.levels else F.expr("cast(array() as array<bigint>)")

    def listed(self, hashes: np.ndarray) -> np.ndarray:
        """keys x 2 hashes a level -> whether each key is listed."""
        passed = np.zeros(len(hashes), np.int64)
        going = np.arange(len(hashes))
        for i, level in enumerate(self.levels):
            going = going[level.passes(hashes[going, 2 * i : 2 * i + 2])]
            passed[going] += 1
        return passed % 2 == 1


def build(ws: Workspace, keys: DataFrame) -> Cascade:
    """A cascade over keys (key string, listed boolean), each key once; exact for all of them.

    Only a level's mistakes go on to the level after the next, so the tables shrink fast; what a level encodes, at
    most about as many keys as are listed, comes to the driver as hashes.
    """
    levels: list[Level] = []
    # inside: the keys this level encodes; outside: those it must refuse
    inside, outside = keys.where("listed").select("key"), keys.where("not listed").select("key")
    while True:
        count, others = inside.count(), outside.count()
        if count == 0:
            return Cascade(levels)
        level = Level(count, min(0.25, 0.5 * count / max(1, others)))
        depth = len(levels)
        found = np.array([r["h"] for r in inside.select(_hashes(F.col("key"), depth).alias("h")).toLocalIterator()], np.int64)
        level.bits[level.spots(found)] = True
        levels.append(level)

        def through(batch: pa.RecordBatch, level=level):
            hashes = batch.column(1).flatten().to_numpy().reshape(-1, 2)
            yield {"key": batch.column(0).take(pa.array(np.flatnonzero(level.passes(hashes))))}

        wrong = arrow_map(outside.select("key", _hashes(F.col("key"), depth)), "key string", through)
        inside, outside = ws.keep(wrong), inside


def url_filter(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, default: str = "allow") -> DataFrame:
    """pages (page_id, url, ...) -> page_id, host, path, rule, verdict: one row per row.

    host: after the first :// up to / ? # or the end, A-Z in lower case; path: from there up to ? # or the
    end.  A null url or one without :// has an empty host and path, which no rule fits.  rule: host and path
    of the longest rule that fits, else null; verdict: the rule's, else `default` (a key that the cascade
    doesn't hold isn't listed).  Repeated rows are judged each; a null page_id stays null; other columns are
    ignored.  rules is a driver-side list, to whose size the filters that every worker gets are proportional.
    """
    spark: SparkSession = pages.sparkSession
    ws = Workspace(spark, "urlfilter")
    url = F.col("url")
    parsed = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))
    named = {h + p: v for h, p, v in rules}
    lengths = sorted({len(p) for _, p, _ in rules}, reverse=True)
    depth = 1 + max((h.count(".") for h, _, _ in rules), default=0)

    parts = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda i: F.concat_ws(".", F.slice(parts, -i, i)))
    paths = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p)))) if rules else F.expr("cast(array() as array<string>)")
    keyed = parsed.withColumn("keys", F.when(F.col("host") == "", F.expr("cast(array() as array<string>)")).otherwise(keys))

    listed = spark.sql("select explode(from_json(:k, 'array<string>')) key", args={"k": _json(list(named))})
    universe = keyed.select(F.explode("keys").alias("key"), F.lit(False).alias("listed")).union(listed.withColumn("listed", F.lit(True)))
    universe = ws.keep(universe.groupBy("key").agg(F.max("listed").alias("listed")))
    member = build(ws, universe)
    blocks = spark.sql("select col.key, col.listed from (select explode(from_json(:k, 'array<struct<key:string,listed:boolean>>')) col)", args={"k": _json([{"key": k, "listed": v == "block"} for k, v in named.items()])})
    block = build(ws, blocks)

    def judge(batch: pa.RecordBatch):
        keys = batch.column("keys")
        sizes = pc.list_value_length(keys).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = keys.flatten()
        asked = lambda n, c: batch.column(n).flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(flat), 2 * len(c.levels))
        hit = member.listed(asked("member", member))
        # of a url's listed keys the longest, and of equally long ones that of the longer host
        rank = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) << 32 | pc.find_substring(flat, "/").to_numpy(zero_copy_only=False)
        best = np.full(len(batch), -1, np.int64)
        some = np.flatnonzero(sizes)
        if len(some):
            starts = (np.cumsum(sizes) - sizes)[some]
            rank = np.where(hit, rank, -1)
            top = np.repeat(np.maximum.reduceat(rank, starts), sizes[some])
            best[some] = np.maximum.reduceat(np.where((rank == top) & hit, np.arange(len(flat)), -1), starts)
        at = pa.array(best, mask=best < 0)
        blocked = pa.array(block.listed(asked("block", block)))
        verdict = pc.if_else(blocked.take(at), "block", "allow") if len(flat) else pa.nulls(len(batch), pa.string())
        yield {n: batch.column(n) for n in ("page_id", "host", "path")} | {"rule": flat.take(at), "verdict": pc.fill_null(verdict, default)}

    kind = dict(pages.dtypes)["page_id"]
    asked = keyed.select("page_id", "host", "path", "keys", F.transform("keys", member.hashes).alias("member"), F.transform("keys", block.hashes).alias("block"))
    return arrow_map(asked, f"page_id {kind}, host string, path string, rule string, verdict string", judge)


def _json(x: object) -> str:
    import json

    return json.dumps(x)
