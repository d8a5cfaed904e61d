import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm import brute
from tidemark.llm import common, linededup


def corpus():
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefé", k=rng.randint(1, 4))) for _ in range(400)]
    lines = [" ".join(rng.choices(vocab, k=rng.choice([1, 2, 3, 4, 5, 8, 20, 40]))) for _ in range(120)]
    base = rng.choices(vocab, k=30)
    for i in range(100):
        copy = list(base)
        copy[i % 30] = f"n{i}"
        lines.append(" ".join(copy))
    rows = []
    for i in range(90):
        text = []
        for _ in range(rng.randint(1, 8)):
            words = rng.choice(lines).split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            text.append(" ".join(words).upper() if rng.random() < 0.1 else " ".join(words))
            if rng.random() < 0.1:
                text.append("  ")
        rows.append((i, "\n".join(text)))
    rng.shuffle(rows)
    return rows + [(200, ""), (201, None), (202, "\n \n"), (203, "word " * 3000), (None, rows[0][1]), rows[5], (7, "a second text\nof a repeated id")] + [(300, f"one two three four five\n{x} other words of this line") for x in "abc"]


@pytest.mark.parametrize("limits", [{}, {"HOT": 2, "BLOCK": 3, "CHUNK": 40}, {"HOT": 1, "LEVELS": 1, "BLOCK": 5, "BROADCAST_ROWS": 0, "BROADCAST_LINES": 0}])
def test_brute_force(spark, monkeypatch, limits):
    """Also with lists of three postings split by the words that follow and in blocks, and without broadcasts."""
    for name, value in limits.items():
        monkeypatch.setattr(linededup, name, value)
        if hasattr(common, name):
            monkeypatch.setattr(common, name, value)
    rows = corpus()
    df = spark.createDataFrame([(d, t, "s", 1, "z") for d, t in rows], "doc_id long, text string, hash string, line int, n_lines string")
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"], r["hash"]) for r in linededup.line_dedup(df).collect()), key=str)
    # documents: each (doc_id, text) once, in the order of lines
    place = lambda d, i, t: (d, i, (xxhash.xxh64(t.encode(), seed=42).intdigest() + 2**63) % 2**64)
    sets = sorted(((d, i, t, frozenset(brute.spaced_words(x))) for d, t in {r for r in rows if r[0] is not None and r[1] is not None} for i, x in enumerate(t.split("\n")) if brute.spaced_words(x)), key=lambda r: place(*r[:3]))
    gone = set()
    for k, (d, i, t, s) in enumerate(sets):
        if any(9 * len(s & e) >= 4 * (len(s) + len(e)) for _, _, _, e in sets[:k]):
            gone.add((d, i, t))
    want = []
    for d, t in rows:
        lines = t.split("\n") if t else []
        kept = "\n".join(x for i, x in enumerate(lines) if (d, i, t) not in gone) if t is not None else None
        want.append((d, kept, sum(bool(brute.spaced_words(x)) for x in lines), sum((d, i, t) in gone for i in range(len(lines))), "s"))
    assert got == sorted(want, key=str)


def test_empty(spark):
    assert linededup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("limits", [{"DENSE": 2, "BLOCK": 3, "PAIRS": 12}, {"HOT": 2, "DENSE": 2, "SPLIT": 4, "LEVELS": 1}, {"HOT": 2, "DENSE": 2, "SPLIT": 4, "LONG": 8}])
def test_long_lists(spark, monkeypatch, limits):
    """Lists compared in blocks, by pieces of their maps, and spread by sizes."""
    test_brute_force(spark, monkeypatch, limits)


def test_long_lists_are_not_multiplied(spark, monkeypatch):
    """Every line of long lists goes to the lists of its prefix words, and no row of a pass holds words."""
    monkeypatch.setattr(linededup, "HOT", 8)
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(i, " ".join(rng.sample(vocab, 40))) for i in range(300)], "doc_id long, text string")
    kept = []
    keep = common.Workspace.keep

    def seen(self, table):
        out = keep(self, table)
        kept.append((table.columns, out.count()))
        return out

    monkeypatch.setattr(common.Workspace, "keep", seen)
    got = linededup.line_dedup(df)
    assert got.where("n_removed > 0").count() == 0
    # 9 words of a line of 40 are its prefix
    assert max(n for _, n in kept) <= 300 * 9
    assert not [c for c, n in kept if "words" in c and n > 300]


@pytest.mark.parametrize("sizes", [(4, 12), (20, 90), (5, 300)])
def test_lists_of_pieces(monkeypatch, sizes):
    """All pairs within the bounds that the maps leave, with and without pieces, some lines done."""
    monkeypatch.setattr(linededup, "SPLIT", 10)
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.integers(0, 2**63, rng.integers(*sizes), dtype=np.uint64)) for _ in range(40)]
    for s in list(sets) * 5:
        drop = rng.random(len(s)) < 0.08
        sets.append(np.unique(np.concatenate([s[~drop], rng.integers(0, 2**63, int(rng.integers(0, 1 + len(s) // 9)), dtype=np.uint64)])))
    sets = [s for s in sets if len(s) > 3]
    n = np.array([len(s) for s in sets])
    node, one, two = linededup._names(np.concatenate(sets), n)
    done, side = rng.random(len(n)) < 0.3, np.zeros(len(n), np.int64)
    want = {(i, j) for i in range(len(n)) for j in range(i) if not (done[i] and done[j]) and node[i] != node[j] and 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (n[i] + n[j])}
    assert len(want) > 50
    for levels in (0, 3, 99):
        monkeypatch.setattr(linededup, "LEVELS", levels)
        got = {(max(i, j), min(i, j)) for a, b in linededup._one_list(n << 8, done, side, node, one, two) for i, j in zip(a.tolist(), b.tolist())}
        assert want <= got
        assert all(not (done[i] and done[j]) for i, j in got)


@pytest.mark.parametrize("limits", [{"HOT": 2, "CROWD": 0, "DENSE": 2}, {"HOT": 2, "CROWD": 1, "DENSE": 2, "LONG": 8}])
def test_crowded_lists(spark, monkeypatch, limits):
    test_brute_force(spark, monkeypatch, limits)


def test_long_lists_of_unlike_lines_stay_in_the_first_pass(spark, monkeypatch):
    """Only lists of near copies are joined again, so that the postings of common words aren't shuffled once more."""
    monkeypatch.setattr(linededup, "HOT", 8)
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    unlike = [(i, " ".join(rng.sample(vocab, 40))) for i in range(300)]
    base = [f"b{i}" for i in range(40)]
    copies = [(1000 + i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(40)]
    hot, rest = [], linededup._Join.rest

    def seen(self, keys):
        hot.append(keys.count())
        rest(self, keys)

    monkeypatch.setattr(linededup._Join, "rest", seen)
    got = linededup.line_dedup(spark.createDataFrame(unlike, "doc_id long, text string"))
    assert got.where("n_removed > 0").count() == 0
    assert hot == []
    got = linededup.line_dedup(spark.createDataFrame(unlike + copies, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.where("n_removed > 0").collect()) == list(range(1001, 1040))
    assert len(hot) == 1 and 0 < hot[0] <= 80


def test_words_of_many_passes_are_counted_at_once(monkeypatch):
    """The sums have BUCKETS places, many more than a pass has words; they are gone through once in that many words."""
    texts = [f"w{i} v{i % 3} W{i}" for i in range(60)]
    want = np.zeros(linededup.BUCKETS, np.int64)
    for t in texts:
        np.add.at(want, linededup._bucket(linededup.kernels.word_hashes([t.encode()])[0]), 1)
    calls, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: calls.append(1) or bincount(*a, **k))
    (out,) = linededup._word_counts([pa.RecordBatch.from_pydict({"text": [t]}) for t in texts])
    assert len(calls) == 1
    assert np.array_equal(np.frombuffer(b"".join(out["counts"].to_pylist()), np.uint32), want)
