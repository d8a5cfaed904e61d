import random

import numpy as np
import pytest

from tests.llm import brute
from tidemark.llm import minhash


def corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(300)]
    rows = []
    for i in range(40):
        words = rng.choices(vocab, k=rng.randint(1, 120))
        rows.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append("\n".join(copy) if rng.random() < 0.3 else " ".join(copy).upper().replace("É", "é"))
    base = rng.choices(vocab, k=200)
    for i in range(30):  # a chain: neighbours are near, the ends are not
        base[i * 3] = f"new{i}"
        rows.append(" ".join(base))
    rows += ["", "   \n", None, "one", "ONE", "one two", "x " * 5000]
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(None, rows[0]), (None, None), (3, rows[3]), (7, "another text of a repeated id")]


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, minhash.BLOCK), (5, 80, minhash.BLOCK), (3, 85, 2)])
def test_brute_force(spark, monkeypatch, k, percent, block):
    """Also with bands that fall into several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, n int")
    got = sorted((tuple(r) for r in minhash.near_duplicates(df, k, percent).collect()), key=str)
    assert got == brute.near_duplicates(rows, k, percent)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df).collect() == []


def test_posterior_prunes_strangers_and_keeps_the_like():
    need = minhash.least_matches(0.85, 1e-9)
    assert need == sorted(need)
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (500, 192), dtype=np.uint8)
    like, far = a.copy(), a.copy()
    like[rng.random(a.shape) < 0.15] ^= 1
    far[rng.random(a.shape) < 0.6] ^= 1
    assert len(minhash.survive(a, like, need)) == 500
    assert len(minhash.survive(a, far, need)) == 0
