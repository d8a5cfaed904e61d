"""MinHash near-duplicates with sequential Bayesian verification.

Texts become sets of word shingles; equal sets collapse into one node first.  Banded MinHash signatures
propose pairs; a pair's signature is compared batch by batch, and the pair is dropped once the posterior
probability that its similarity reaches the threshold is below `miss` (uniform prior, one byte of each
signature value); survivors are verified exactly on their full sets.

A bucket never emits all of its pairs.  First each member meets only the bucket's smallest node; links so
found join nodes into components.  Only buckets that still hold several components are compared further, in
blocks of at most `BLOCK` members a side, only across components, and only surviving pairs leave a block.
A group of near copies of any size is thus linear unless its members differ from each other as much as
from strangers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import Workspace, arrow_map, light
from .components import components

#: a pair at Jaccard 0.85 shares no band with probability 2.6e-7, at 0.8 with 4.9e-5 (more bands: less)
BANDS, ROWS = 32, 6
BLOCK = 512
BATCH = 32
_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_MIX = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_work = np.empty((256, BANDS * ROWS), np.uint32)


def signature(values: np.ndarray) -> np.ndarray:
    """The minimum of each of the BANDS * ROWS hash functions over a set."""
    s = (values >> np.uint64(32)).astype(np.uint32)
    out = None
    for at in range(0, len(s), len(_work)):
        part = s[at : at + len(_work), None]
        work = _work[: len(part)]
        np.multiply(part, _A, out=work)
        np.add(work, _B, out=work)
        low = work.min(0)
        out = low if out is None else np.minimum(out, low)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and signature, different for different bands."""
    rows = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return kernels.mix(kernels.mix((rows + np.uint64(1)) * _MIX).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def least_matches(threshold: float, miss: float, total: int = BANDS * ROWS, batch: int = BATCH) -> list[int]:
    """After each batch, the fewest equal signature bytes with P(similarity >= threshold | matches) >= miss."""
    p = threshold + (1 - threshold) / 256
    need = []
    for n in range(batch, total + 1, batch):
        # the posterior is Beta(m + 1, n - m + 1), whose upper tail at p is P(Binomial(n + 1, p) <= m)
        term, below, m = (1 - p) ** (n + 1), 0.0, 0
        while True:
            below += term
            if below >= miss:
                break
            term *= (n + 1 - m) / (m + 1) * p / (1 - p)
            m += 1
        need.append(m)
    return need


def survive(a: np.ndarray, b: np.ndarray, need: list[int]) -> np.ndarray:
    """Indices of the rows of two byte matrices that no batch prunes."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for i, least in enumerate(need):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches = matches + (a[alive, part] == b[alive, part]).sum(1)
        good = matches >= least
        alive, matches = alive[good], matches[good]
    return alive


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=f"S{BANDS * ROWS}").view(np.uint8).reshape(-1, BANDS * ROWS) if len(column) else np.empty((0, BANDS * ROWS), np.uint8)


def _sketch(k: int):
    def f(batch: pa.RecordBatch):
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for first, run in kernels.passes(texts):
            sizes, nodes, sigs = [], [], []
            for s in kernels.run_shingles(*kernels.word_hashes(run), k):
                sizes.append(len(s))
                nodes.append(kernels.set_hash(s) if len(s) else None)
                if len(s):
                    sigs.append(signature(s))
            sig = np.array(sigs, np.uint32).reshape(-1, BANDS * ROWS)
            keys, low = iter(band_keys(sig)), iter((sig & 255).astype(np.uint8))
            yield {
                "doc_id": ids.slice(first, len(run)),
                "n": sizes,
                "node": nodes,
                "bands": [next(keys) if n else None for n in sizes],
                "sig": [next(low).tobytes() if n else None for n in sizes],
                **{name: batch.column(name).slice(first, len(run)) for name in batch.schema.names[2:]},
            }

    return f


def _sets(k: int):
    def f(batch: pa.RecordBatch):
        texts = batch.column(0).to_pylist()
        for _, run in kernels.passes(texts):
            out = [s for s in kernels.run_shingles(*kernels.word_hashes(run), k) if len(s)]
            yield {"node": [kernels.set_hash(s) for s in out], "hashes": [s.view(np.int64) for s in out]}

    return f


def _pairs(need: list[int]):
    """Of (a, b, sig_a, sig_b), the pairs that survive."""

    def f(batch: pa.RecordBatch):
        alive = pa.array(survive(_matrix(batch.column(2)), _matrix(batch.column(3)), need))
        yield {"a": batch.column(0).take(alive), "b": batch.column(1).take(alive)}

    return f


def _blocks(need: list[int], percent: int):
    """Rows (block, side, node, root, n, sig) sorted by block -> surviving pairs across components."""

    def compare(rows: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(rows).combine_chunks()
        side, node, root, n = (whole.column(c).to_numpy() for c in ("side", "node", "root", "n"))
        sig = _matrix(whole.column("sig").combine_chunks())
        one = np.flatnonzero(side != 2)
        two = np.flatnonzero(side != 1)
        found = []
        for at in range(0, len(one), 64):
            x = one[at : at + 64]
            i, j = np.meshgrid(x, two, indexing="ij")
            i, j = i.ravel(), j.ravel()
            ok = (root[i] != root[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((side[i] == 1) | (node[i] < node[j]))
            i, j = i[ok], j[ok]
            alive = survive(sig[i], sig[j], need)
            found.append(np.sort(np.stack([node[i[alive]], node[j[alive]]]), 0))
        return np.unique(np.concatenate(found, 1), axis=1) if found else np.empty((2, 0), np.int64)

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column(0).to_pylist()
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if held and held[0].column(0)[0].as_py() != keys[at]:
                    pairs = compare(held)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=schema)
                    held = []
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            pairs = compare(held)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=schema)

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-9, rows: bool = False, ws: Workspace | None = None) -> DataFrame:
    """docs (doc_id long, text string, ...) -> one row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case; a text's set holds its distinct k-word shingles, or
    the whole sequence if it has fewer words.  Texts are linked if 100 * intersection >= percent * union.
    Null, empty and blank texts have no set and are linked with nothing.  Rows that repeat a doc_id are
    rows of their own with one id.  A row whose doc_id is null can't be named by others: it gets a null
    component_id and is kept.  Other columns are ignored; an empty table gives an empty result.

    With rows, a row is told by its doc_id and its text: there are further columns hash (xxhash64 of the text)
    and first, whether no row of its component comes before it in the order of (doc_id, hash).  The result reads tables
    in ws, or in a workspace of its own.
    """
    ws = ws or Workspace(docs.sparkSession, "minhash")
    need = least_matches(percent / 100, miss)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.xxhash64("text").alias("hash")] * rows)
    sketch = ws.keep(arrow_map(docs, "doc_id long, n long, node long, bands array<long>, sig binary" + ", hash long" * rows, _sketch(k)))
    sets = sketch.where("node is not null and doc_id is not null")

    banded = sets.select("node", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("band", "head")
    members = ws.keep(banded.join(heads, "band").select("band", "node", "head").distinct())
    nodes = members.select("node").union(members.select("head")).distinct()
    chosen = ws.keep(sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.min_by(F.struct("doc_id", "n", "sig"), "doc_id").alias("r")).select("node", F.col("r.doc_id").alias("rep"), F.col("r.n").alias("n"), F.col("r.sig").alias("sig")))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets, made again from the texts, are similar enough."""
        pairs = ws.keep(pairs)
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(chosen.select("node", "rep"), "node")
        texts = docs.join(light(ends.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi").select("text")
        full = ws.keep(arrow_map(texts, "node long, hashes array<long>", _sets(k)).join(ends.select("node"), "node", "left_semi").dropDuplicates(["node"]))
        both = pairs.join(full.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(full.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
        common = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("common"), (F.size("x") + F.size("y")).cast("long").alias("total"))
        out = ws.keep(common.where(f"100 * common >= {percent} * (total - common)").select("a", "b"))
        ws.drop(pairs, full)
        return out

    def side(name: str) -> DataFrame:
        return chosen.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}"))

    star = members.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    star = star.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    links = verified(arrow_map(star.select("a", "b", "sig_a", "sig_b"), "a long, b long", _pairs(need)))

    roots = ws.keep(components(ws, links))
    rooted = members.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    open_bands = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("band", "size")
    spread = rooted.join(open_bands, "band").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    spread = spread.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = spread.select("band", "node", "root", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    spread = spread.select(
        F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")).alias("block"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
        "node", "root",
    ).join(chosen.select("node", "n", "sig"), "node").select("block", "side", "node", "root", "n", "sig")
    spread = spread.repartition("block").sortWithinPartitions("block")
    more = spread.mapInArrow(_blocks(need, percent), "a long, b long").distinct()
    links2 = verified(more.join(links, ["a", "b"], "left_anti"))

    # a whole component of the first round acts as one node in the second
    roots = ws.keep(components(ws, roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links2.select("a", "b"))))
    name = F.struct("doc_id", *["hash"] * rows)
    classes = sets.groupBy("node").agg((F.min(name) if rows else F.struct(F.min("doc_id").alias("doc_id"))).alias("first"))
    named = classes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = F.min("first") if rows else F.struct(F.min("first.doc_id").alias("doc_id"))
    named = named.join(named.groupBy("root").agg(least.alias("leader")), "root").select("node", "leader")
    out = sketch.join(named, "node", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("leader.doc_id", "doc_id")))
    more = ["hash", F.coalesce(name == F.col("leader"), F.lit(True)).alias("first")] if rows else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), *more)
