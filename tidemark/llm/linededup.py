"""Line dedup by an exact set-similarity join.

A line is the set of its words ([^\\x20\\x09-\\x0D]+, A-Z in lower case); lines without words are never touched.
Lines with equal sets form a class, whose first line in the order (doc_id, line number, hash of the text) stands for it.  A
line is removed if an earlier line's Jaccard similarity to it is 0.8 or more: that is so for all but the
first line of a class, and for that one if its class is linked to a class that began earlier.

Links between classes come from a prefix-filtered join: words are ordered by rarity over all documents (by
counts in BUCKETS hash buckets, a fixed size, then by hash - any order gives the same result), and two sets of
n and m words can only be linked if their prefixes of n - ceil(0.8 n) + 1 and m - ceil(0.8 m) + 1 words meet.
One shuffle brings the postings of a word together, sorted by size; a posting is four numbers.  Sizes
(0.8 n <= m <= n / 0.8), the places of the first common word, and 128-bit parity maps of the sets (whose
distance is at most that of the sets) bound the overlap; what remains is verified on the full sets, each
later line's earliest candidate first, and the others only for lines that this leaves.

That pass compares lists whole, the maps of a long one block against block; where a list has more than SPLIT
postings of a band of sizes, it looks only at those that agree on one of the pieces of their maps, since of d + 1
pieces one agrees if d bits differ at most.  Only the names of two kinds of lists leave it: those of more than LONG
postings, and of those of more than HOT the crowded ones, in which more than CROWD pairs a posting remain, as in
groups of near copies.  As a line needs one earlier match only, their lines first meet the earliest line of each
list; lines so matched look no further, although others may still match them.  A group of near copies is thus
linear in its size.  Then a second shuffle, again of four numbers a posting, brings these lists together whole:
nothing is multiplied by words that follow or by blocks, but lists of more than LONG postings are spread by sizes,
each posting going to two bands of sizes.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import BROADCAST_ROWS, Workspace, arrow_map, light, unused

BUCKETS, SEGMENTS = 1 << 19, 64
#: a list of up to HOT postings is joined at once, one of up to LONG unless it is crowded, and one of more than LONG by
#: bands of sizes; pairs a posting of a list that isn't crowded
HOT, LONG, CROWD = 512, 1 << 17, 4
#: a list of more than DENSE postings is compared in blocks of BLOCK; of more than SPLIT of a band by pieces of
#: their maps, if these halve the pairs LEVELS times at least
DENSE, BLOCK, SPLIT, LEVELS = 48, 32, 4096, 3
#: postings of one pass in numpy, and pairs looked at together
CHUNK, PAIRS = 300_000, 500_000
#: the order of lines as one number, whose minimum a hash aggregate can keep; the upper 30 bits of the hash tell lines of
#: one number in two texts of one doc_id apart
_ORDER_SQL = "cast(doc_id as decimal(19,0)) * cast(2305843009213693952 as decimal(19,0)) + cast(cast(line as bigint) * 1073741824 + (shiftright(hash, 34) + 536870912) as decimal(19,0))"
#: removed lines that may be broadcast with their documents' ids
BROADCAST_LINES = 4_000_000


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(45)).astype(np.intp)


def _word_counts(batches):
    total = np.zeros(BUCKETS, np.int64)
    held: list[np.ndarray] = []

    def add() -> None:
        nonlocal total
        if held:
            total += np.bincount(np.concatenate(held), minlength=BUCKETS)
            held.clear()

    for batch in batches:
        for _, run in kernels.passes(batch.column(0).to_pylist()):
            held.append(_bucket(kernels.word_hashes(run)[0]))
            # the sums have many more places than a run has words
            if sum(map(len, held)) >= BUCKETS:
                add()
    add()
    parts = total.reshape(SEGMENTS, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array([p.astype(np.uint32 if p.max() < 2**32 else np.int64).tobytes() for p in parts])], names=["segment", "counts"])


def _sum_counts(batches):
    sums: dict[int, np.ndarray] = {}
    size = BUCKETS // SEGMENTS
    for batch in batches:
        for segment, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(data, np.uint32 if len(data) == 4 * size else np.int64)
            sums[segment] = sums.get(segment, 0) + part.astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["segment", "counts"])


def word_counts(docs: DataFrame) -> np.ndarray:
    """How often the words of each bucket occur in all texts; BUCKETS numbers."""
    schema = "segment int, counts binary"
    rows = docs.select("text").mapInArrow(_word_counts, schema).repartition(SEGMENTS, "segment").mapInArrow(_sum_counts, schema).collect()
    out = np.zeros((SEGMENTS, BUCKETS // SEGMENTS), np.int64)
    for segment, data in rows:
        out[segment] = np.frombuffer(data, np.int64)
    return out.reshape(-1)


@lru_cache(maxsize=1)
def _classes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint16)


def _sorted_sets(run: list[bytes], rarity: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each line of a run, rarest first, and how many each line has."""
    hashes, bounds = kernels.word_hashes(run)
    line = np.repeat(np.arange(len(run), dtype=np.uint64), np.diff(bounds))
    key = line << np.uint64(44) | hashes >> np.uint64(32)
    if rarity is not None:
        key |= rarity[_bucket(hashes)].astype(np.uint64) << np.uint64(32)
    order = np.argsort(key)
    hashes, line = hashes[order], line[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])
    return hashes[fresh], np.bincount(line[fresh].astype(np.intp), minlength=len(run))


def _names(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit name of each set, and the two halves of its parity map."""
    some = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[some]
    names, one, two = (np.zeros(len(sizes), np.uint64) for _ in range(3))
    if len(starts):
        total = np.add.reduceat(kernels.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
        names[some] = kernels.mix(total + sizes[some].astype(np.uint64))
        bit, high = np.uint64(1) << (hashes & np.uint64(63)), hashes & np.uint64(64) > 0
        one[some] = np.bitwise_xor.reduceat(np.where(high, np.uint64(0), bit), starts)
        two[some] = np.bitwise_xor.reduceat(np.where(high, bit, np.uint64(0)), starts)
    return names.view(np.int64), one.view(np.int64), two.view(np.int64)


def _lines(texts: list[str | None]):
    """(index of the text, line number, lines) in passes."""
    owners, numbers, lines = [], [], []
    for i, text in enumerate(texts):
        parts = text.split("\n") if text else []
        owners += [i] * len(parts)
        numbers += range(len(parts))
        lines += parts
    for first, run in kernels.passes(lines):
        yield np.array(owners[first : first + len(run)]), np.array(numbers[first : first + len(run)], np.int32), run


def _index(rarity_data: bytes):
    def f(batch: pa.RecordBatch):
        rarity = _classes(rarity_data)
        for owner, number, run in _lines(batch.column("text").to_pylist()):
            hashes, sizes = _sorted_sets(run, rarity)
            names, one, two = _names(hashes, sizes)
            place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            # sets of up to three words are linked with equal ones only
            per = np.where(sizes > 3, sizes - (4 * sizes + 4) // 5 + 1, 0)
            wanted = place < np.repeat(per, sizes)
            some = sizes > 0
            ends = np.zeros(int(some.sum()) + 1, np.int32)
            np.cumsum(per[some], out=ends[1:])
            yield {
                "doc_id": batch.column("doc_id").take(pa.array(owner[some])),
                "hash": batch.column("hash").take(pa.array(owner[some])),
                "line": number[some],
                "node": names[some],
                "n": sizes[some].astype(np.int32),
                "one": one[some],
                "two": two[some],
                "words": pa.ListArray.from_arrays(pa.array(ends), pa.array((hashes[wanted] >> np.uint64(32)).astype(np.uint32).view(np.int32))),
            }

    return f


def _near(key, size, done, side, node, one, two):
    """Pairs (indices) of rows with one key, sorted by key, whose sets may reach 0.8; of two one isn't done.

    size: the number of words << 8 | the place of the common word (at most 255: a smaller place only bounds less).
    side: 0, or 2 for those that only meet others.
    """
    group = np.zeros(len(key), np.int64)
    np.cumsum(key[1:] != key[:-1], out=group[1:])
    n, place = size >> 8, size & 255
    order = np.lexsort((n, done, group))
    n_, free = n[order], ~done[order]
    at = group[order] << 33
    spot = at | done[order].astype(np.int64) << 32 | n_
    for other in (False, True):
        if other:  # those that are done
            low, high = np.searchsorted(spot, at | 1 << 32 | -(-n_ * 4 // 5)), np.searchsorted(spot, at | 1 << 32 | n_ * 5 // 4, "right")
            count = np.where(free, high - low, 0)
        else:  # the larger of two
            low = np.arange(1, len(n_) + 1)
            high = np.searchsorted(spot, at | n_ * 5 // 4, "right")
            count = np.where(free & (9 * place[order] <= n_), np.maximum(high - low, 0), 0)
        sums = np.concatenate([[0], np.cumsum(count)])
        first = 0
        while first < len(count):
            last = max(first + 1, int(np.searchsorted(sums, sums[first] + PAIRS, "right")) - 1)
            c = count[first:last]
            i = np.repeat(np.arange(first, last), c)
            j = order[np.repeat(low[first:last] - (sums[first:last] - sums[first]), c) + np.arange(len(i))]
            i = order[i]
            total = n[i] + n[j]
            good = (9 * np.minimum(n[i] - place[i], n[j] - place[j]) >= 4 * total) & (node[i] != node[j])
            i, j, total = i[good], j[good], total[good]
            # of signed numbers, numpy counts the bits of the absolute value
            apart = np.bitwise_count((one[i] ^ one[j]).view(np.uint64)).astype(np.int64) + np.bitwise_count((two[i] ^ two[j]).view(np.uint64))
            good = 9 * apart <= total
            i, j = i[good], j[good]
            good = (side[i] != side[j]) | (side[i] == 0)
            yield i[good], j[good]
            first = last


def _dense(size, done, side, node, one, two):
    """Like _near, of the postings of one list: maps block against block, the other bounds on what these leave."""
    order = np.argsort(size >> 8, kind="stable")
    size, done, side, node, one, two = size[order], done[order], side[order], node[order], one[order].view(np.uint64), two[order].view(np.uint64)
    n, place = size >> 8, size & 255
    rest, free = n - place, np.flatnonzero(~done)
    # of two that are free the smaller looks for the larger; whoever is done is looked for
    for mine, other in ((free[9 * place[free] <= n[free]], free), (free, np.flatnonzero(done))):
        low_n = n[other]
        for at in range(0, len(mine), BLOCK):
            i = mine[at : at + BLOCK]
            least = n[i[0]] if other is free else -(-n[i[0]] * 4 // 5)
            j = other[np.searchsorted(low_n, least) : np.searchsorted(low_n, n[i[-1]] * 5 // 4, "right")]
            for first in range(0, len(j), PAIRS // BLOCK):
                k = j[first : first + PAIRS // BLOCK]
                apart = np.bitwise_count(one[i, None] ^ one[k])
                apart += np.bitwise_count(two[i, None] ^ two[k])
                x, y = np.nonzero(apart <= min(255, (n[i[-1]] + n[k[-1]]) // 9))
                apart, x, y = apart[x, y].astype(np.int64), i[x], k[y]
                total = n[x] + n[y]
                good = (9 * apart <= total) & (9 * np.minimum(rest[x], rest[y]) >= 4 * total) & (5 * n[x] >= 4 * n[y]) & (5 * n[y] >= 4 * n[x])
                good &= (node[x] != node[y]) & ((side[x] != side[y]) | (side[x] == 0))
                yield order[x[good]], order[y[good]]


def _distinct(pairs: list[np.ndarray]) -> np.ndarray:
    a, b = np.concatenate(pairs, 1)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.stack([a[fresh], b[fresh]])


def _band(n: np.ndarray) -> np.ndarray:
    """Two sizes of 0.8 <= n / m <= 1 / 0.8 fall into one band or neighbours, as a band ends at 1.26 times its start."""
    return (np.log(n) / np.log(1.26)).astype(np.int64)


def _pieces(one, two, parts: int):
    """The bits of each of `parts` pieces of 128-bit maps."""
    ends = [128 * i // parts for i in range(parts + 1)]
    for a, b in zip(ends[:-1], ends[1:]):
        out = np.zeros(len(one), np.uint64)
        for half, start in ((one, 0), (two, 64)):
            low, high = max(a, start), min(b, start + 64)
            if low < high:
                ours = half.view(np.uint64) >> np.uint64(low - start)
                if high - low < 64:
                    ours = ours & np.uint64((1 << (high - low)) - 1)
                out = out * np.uint64(0xD6E8FEB86659FD93) + ours
        yield out


def _one_list(size, done, side, node, one, two):
    """_dense, or for each band of sizes with too much in it _near of those that agree on a piece of their maps."""
    if len(size) <= SPLIT:
        yield from _dense(size, done, side, node, one, two)
        return
    n = size >> 8
    band = _band(n)
    for b in np.unique(band).tolist():
        at = np.flatnonzero((band == b) | (band == b + 1))
        # those of the next band meet each other in its turn
        upper = np.where(band[at] == b, side[at], 2)
        if not ((upper == 0).any() and (~done[at]).any()):
            continue
        most = int(n[at][band[at] == b].max())
        parts = (most + min(most * 5 // 4, int(n[at].max()))) // 9 + 1
        if len(at) <= SPLIT or parts << LEVELS > 2 ** (128 // parts):
            for i, j in _dense(size[at], done[at], upper, node[at], one[at], two[at]):
                yield at[i], at[j]
            continue
        for piece in _pieces(one[at], two[at], parts):
            order = np.argsort(piece)
            piece, now = piece[order], at[order]
            for i, j in _near(piece, size[now], done[now], upper[order], node[now], one[now], two[now]):
                yield now[i], now[j]


def _few(pairs, node: np.ndarray, most: int) -> np.ndarray | None:
    """The distinct pairs of nodes; none if there are more than `most`."""
    found, held = [], 0
    for i, j in pairs:
        if len(i):
            found.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]))
            held += len(i)
        if held > 2 * most:
            found = [_distinct(found)]
            held = found[0].shape[1]
            if held > most:
                return None
    out = _distinct(found) if found else np.zeros((2, 0), np.int64)
    return out if out.shape[1] <= most else None


def _lists(hot: int | None, long: int | None = None):
    """Postings sorted by key -> pairs (a, b) of nodes; a list of more than `long` postings, or of more than `hot` with
    more than CROWD pairs a posting, gives (key, null) instead.

    Rows are (k, node, one, two), k being key << 32 | done << 31 | size, or (key, size, mark, node, one, two), mark
    being side << 1 | done.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def columns(batches: list[pa.RecordBatch]) -> list[np.ndarray]:
        got = [np.concatenate([b.column(i).to_numpy() for b in batches]) for i in range(batches[0].num_columns)]
        if len(got) == 4:
            got = [got[0] >> 32, got[0] & 0x7FFFFFFF, got[0] >> 31 & 1, *got[1:]]
        return got

    def out(a, b=None):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], schema=schema)

    def near(key, size, mark, node, one, two):
        found, held = [], 0

        def add(pairs, node) -> int:
            new = [np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]) for i, j in pairs if len(i)]
            found.extend(new)
            return sum(x.shape[1] for x in new)

        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])[: None if len(key) else 1]
        dense = np.diff(starts) > DENSE
        if hot is not None:
            dense |= np.diff(starts) > hot
        few = ~np.repeat(dense, np.diff(starts))
        done, side = mark & 1 > 0, mark >> 1
        held += add(_near(*(x[few] for x in (key, size, done, side, node, one, two))), node[few])
        crowded = []
        for a, b in zip(starts[:-1][dense].tolist(), starts[1:][dense].tolist()):
            pairs = _one_list(*(x[a:b] for x in (size, done, side, node, one, two)))
            if hot is None or b - a <= hot:
                held += add(pairs, node[a:b])
            elif (these := _few(pairs, node[a:b], CROWD * (b - a))) is None:
                crowded.append(key[a])
            else:
                found.append(these)
                held += these.shape[1]
            if held > PAIRS:
                yield out(*_distinct(found))
                found, held = [], 0
        if found:
            yield out(*_distinct(found))
        if crowded:
            yield out(crowded)

    def run(batches):
        held: list[np.ndarray] | None = None
        passed: int | None = None  # the list that is passed over
        waiting: list[pa.RecordBatch] = []

        def work(now: list[np.ndarray], final: bool):
            nonlocal passed
            if passed is not None:
                now = [x[now[0] != passed] for x in now]
            if not len(now[0]):
                return now
            starts = np.concatenate([[0], np.flatnonzero(now[0][1:] != now[0][:-1]) + 1])
            sizes = np.diff(np.concatenate([starts, [len(now[0])]]))
            cut = len(now[0]) if final else int(starts[-1])
            over = np.zeros(len(starts), bool) if long is None else sizes > long
            if over[-1]:
                cut, passed = len(now[0]), int(now[0][-1])
            some = np.repeat(~over, sizes)
            some[cut:] = False
            if over.any():
                yield out(now[0][starts[over]])
            yield from near(*(x[some] for x in now))
            return [x[cut:] for x in now]

        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) >= CHUNK:
                now = columns(waiting)
                waiting = []
                held = yield from work([np.concatenate(x) for x in zip(held, now)] if held else now, False)
        if waiting or held:
            now = columns(waiting) if waiting else held
            yield from work([np.concatenate(x) for x in zip(held, now)] if held and waiting else now, True)

    return run


def _full(batch: pa.RecordBatch):
    for _, _, run in _lines(batch.column(0).to_pylist()):
        hashes, sizes = _sorted_sets(run, None)
        names = _names(hashes, sizes)[0]
        some = sizes > 3
        keep = np.repeat(some, sizes)
        ends = np.zeros(int(some.sum()) + 1, np.int32)
        np.cumsum(sizes[some], out=ends[1:])
        yield {"node": names[some], "words": pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[keep].view(np.int64)))}


def _bounds(a: str, b: str) -> Column:
    """Whether the sizes, places and maps of two postings let their sets reach 0.8."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at"))
    apart = sum(F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in ("one", "two"))
    return (5 * n >= 4 * m) & (5 * m >= 4 * n) & (9 * rest >= 4 * (n + m)) & (n + m >= 9 * apart)


def _size(place: str) -> str:
    return f"shiftleft(cast(least(n, {(1 << 23) - 1}) as bigint), 8) | least({place}, 255)"


class _Join:
    """The set-similarity join of the heads (doc_id, line, hash, node, n, one, two, words) of docs (doc_id, text)."""

    def __init__(self, ws: Workspace, docs: DataFrame, heads: DataFrame):
        self.ws, self.docs, self.heads = ws, docs, heads.where("n > 3")
        # the words of a head's prefix
        self.prefix = "n - ceil(n * 4 / 5) + 1"
        #: nodes known to be linked with an earlier one
        self.gone: DataFrame = ws.keep(ws.spark.range(0).select(F.col("id").alias("node")))

    def first(self) -> DataFrame:
        """The links of all lists up to LONG that aren't crowded; returns the others' names (key)."""
        rows = self.heads.select("node", "one", "two", "n", F.posexplode(F.expr(f"slice(words, 1, cast({self.prefix} as int))")).alias("at", "word"))
        rows = rows.selectExpr(f"shiftleft(cast(word as bigint), 32) | {_size('at')} as k", "node", "one", "two")
        rows = rows.repartition(F.shiftright("k", 32)).sortWithinPartitions("k")
        found = self.ws.keep(rows.mapInArrow(_lists(HOT, LONG), "a long, b long"))
        self.verify(found.where("b is not null").distinct())
        return self.ws.keep(found.where("b is null").select(F.col("a").alias("key")))

    def verify(self, pairs: DataFrame) -> None:
        """Adds to gone what the full sets confirm: of each pair (a, b) the later one, unless it is known."""
        ws, pairs = self.ws, self.ws.keep(pairs)
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        ends = ws.keep(ends.join(self.heads.select("node", "doc_id", "line", "hash"), "node"))
        end = lambda x: ends.select(F.col("node").alias(x), F.struct("doc_id", "line", "hash").alias(f"at_{x}"))
        both = pairs.join(end("a"), "a").join(end("b"), "b")
        swap = F.col("at_a") > F.col("at_b")
        pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
        both = both.select(pick("a", "b").alias("early"), pick("b", "a").alias("node"), F.least("at_a", "at_b").alias("at"))
        both = ws.keep(both.join(light(self.gone), "node", "left_anti"))
        texts = self.docs.join(light(ends.select("doc_id").distinct()), "doc_id", "left_semi").select("text")
        full = arrow_map(texts, "node long, words array<long>", _full).join(light(both.select(F.explode(F.array("early", "node")).alias("node")).distinct()), "node", "left_semi")
        full = ws.keep(full.dropDuplicates(["node"]))

        def confirmed(these: DataFrame) -> DataFrame:
            sets = these.join(full.select(F.col("node").alias("early"), F.col("words").alias("x")), "early").join(full.select("node", F.col("words").alias("y")), "node")
            common = sets.select("node", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("total"))
            return common.where("9 * common >= 4 * total").select("node").distinct()

        one = ws.keep(confirmed(both.groupBy("node").agg(F.min_by("early", "at").alias("early"))))
        rest = confirmed(both.join(light(one), "node", "left_anti"))
        self.gone = ws.keep(self.gone.union(one).union(rest))
        ws.drop(pairs, ends, both, full)

    def rest(self, hot: DataFrame) -> None:
        """The links of the lists of these keys."""
        ws, hot = self.ws, light(hot)
        explode = F.posexplode(F.expr(f"slice(words, 1, cast({self.prefix} as int))")).alias("at", "word")

        def postings(heads: DataFrame, *more: str) -> DataFrame:
            rows = heads.select("node", "n", "one", "two", *more, explode)
            return rows.withColumn("key", F.col("word").cast("long")).drop("word").join(hot, "key", "left_semi")

        rows = postings(self.heads, "doc_id", "line", "hash").withColumn("order", F.expr(_ORDER_SQL)).drop("doc_id", "line", "hash")
        lists = ws.keep(rows.groupBy("key").agg(F.min("order").alias("first"), F.count("*").alias("members")))
        n = lists.count()
        leads = ws.keep(rows.join(light(lists.select("key", "first"), n), "key").where("order = first").drop("order", "first"))
        led = postings(self.heads).alias("p").join(light(leads, n).alias("l"), "key").where((F.col("p.node") != F.col("l.node")) & _bounds("l", "p"))
        self.verify(led.select(F.least("l.node", "p.node").alias("a"), F.greatest("l.node", "p.node").alias("b")).distinct())
        known = light(self.gone.withColumn("known", F.lit(1)))
        rows = postings(self.heads.join(known, "node", "left").withColumn("done", F.coalesce("known", F.lit(0)).cast("long")), "done")
        rows = rows.selectExpr("key", f"{_size('at')} as size", "n", "done", "node", "one", "two")
        long = ws.keep(lists.where(F.col("members") > LONG).select("key"))
        few = rows
        if not long.isEmpty():
            few = rows.join(light(long), "key", "left_anti")
            self._long(rows.join(light(long), "key", "left_semi"))
        few = few.selectExpr("shiftleft(key, 32) | shiftleft(done, 31) | size as k", "node", "one", "two")
        few = few.repartition(F.shiftright("k", 32)).sortWithinPartitions("k")
        self.verify(few.mapInArrow(_lists(None), "a long, b long").distinct())

    def _long(self, rows: DataFrame) -> None:
        """The links of lists that are spread by sizes: each posting meets those of its band, and of the one below."""
        rows = rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.26)))).select("*", F.explode(F.array(F.lit(0), F.lit(2))).alias("side"))
        rows = rows.select(F.xxhash64("key", F.col("band") - F.when(F.col("side") > 0, 1).otherwise(0)).alias("key"), "size", (F.col("done") + 2 * F.col("side")).alias("mark"), "node", "one", "two")
        self.verify(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_lists(None), "a long, b long").distinct())


def removed_lines(ws: Workspace, docs: DataFrame) -> DataFrame:
    """docs (doc_id not null, hash, text) -> doc_id, hash, line: the lines that an earlier line matches."""
    counts = word_counts(docs)
    rarity = np.minimum(np.log2(counts + 1) * 64, 4095).astype(np.uint16).tobytes()
    schema = "doc_id long, hash long, line int, node long, n int, one long, two long, words array<int>"
    lines = ws.keep(arrow_map(docs, schema, _index(rarity)))
    # where sets that more than one line has begin
    order = F.expr(_ORDER_SQL)
    firsts = ws.keep(lines.groupBy("node").agg(F.min(order).alias("first"), F.count("*").alias("lines")).where("lines > 1").select("node", "first"))
    n = firsts.count()
    ranked = lines.join(light(firsts, n), "node", "left").withColumn("head", F.coalesce(F.col("first") == order, F.lit(True))).drop("first")
    if n > BROADCAST_ROWS:
        ranked = ws.keep(ranked)
        ws.drop(lines)
    heads = ranked.where("head").drop("head")
    join = _Join(ws, docs, heads)
    hot = join.first()
    if not hot.isEmpty():
        join.rest(hot)
    first = ranked.where("head").join(light(join.gone), "node", "left_semi")
    return ranked.where("not head").select("doc_id", "hash", "line").union(first.select("doc_id", "hash", "line"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> docs with the text's removed lines left out, and n_lines (lines with words) and
    n_removed: one row per row.

    A null text stays null, an empty one empty, with no lines.  Rows that repeat a doc_id and its text are one
    document, and all keep the same lines; different texts of one doc_id are documents of their own, and of
    their lines of one number the text with the smaller hash comes first.  A row
    whose doc_id is null has no place in the order: it takes no part and stays as it is.  Columns of docs named
    n_lines or n_removed are replaced; others stay.
    """
    ws = Workspace(docs.sparkSession, "linededup")
    part = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    gone = removed_lines(ws, part).distinct().groupBy("doc_id", "hash").agg(F.collect_set("line").alias("gone"))
    owner, name, numbers = unused(docs, "owner", "hash", "gone")
    gone = ws.keep(gone.select(F.col("doc_id").alias(owner), F.col("hash").alias(name), F.col("gone").alias(numbers)))
    ws.only(gone)
    rows, lines = gone.agg(F.count("*"), F.coalesce(F.sum(F.size(numbers)), F.lit(0))).first()
    gone = light(gone, rows if lines <= BROADCAST_LINES else BROADCAST_ROWS + 1)
    out = docs.join(gone, (F.col("doc_id").cast("long") == F.col(owner)) & (F.xxhash64("text") == F.col(name)), "left")
    lines = F.split("text", "\n")
    kept = F.when(F.col(numbers).isNull(), F.col("text")).otherwise(F.concat_ws("\n", F.filter(lines, lambda _, i: ~F.array_contains(numbers, i))))
    number = F.size(F.filter(F.coalesce(lines, F.expr("cast(array() as array<string>)")), lambda p: F.btrim(p, F.lit(" \t\n\x0b\x0c\r")) != ""))
    out = out.withColumns({"n_lines": number.cast("long"), "n_removed": F.coalesce(F.size(numbers), F.lit(0)).cast("long")})
    return out.withColumn("text", kept).drop(owner, name, numbers)
