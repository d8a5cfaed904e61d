"""Array kernels shared by the operators that work on word hashes.

A batch of texts is one byte buffer; words are found, lower-cased (A-Z only) and hashed with a
handful of passes over that buffer, so that no Python code runs per word.  Hashes have 64 bits and
are the same on every machine and in every run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(2**61, 2**62)) * 4 + 3
_ROLL = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A-Z to a-z, as bytes.translate takes it
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def word_mask(outside: str) -> bytes:
    """A translate table: 1 for bytes of words, 0 for the characters given (all of one byte)."""
    return bytes(int(chr(i) not in outside) for i in range(256))


#: words [^\x20\x09-\x0D]+
SPACED = word_mask(" \t\n\x0b\x0c\r")
#: bytes of one pass (a longer text is a pass of its own); its arrays take about thirty times as much
PASS_BYTES = 100_000
_scratch: dict[str, np.ndarray] = {}


def _buffers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, and two work arrays, kept for the largest n so far."""
    if not _scratch or len(_scratch["work"]) < n:
        size = max(2 * n, 2 * PASS_BYTES)
        for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 2**64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _scratch[name] = np.multiply.accumulate(out)
        _scratch["work"], _scratch["total"] = np.empty(size, np.uint64), np.zeros(size, np.uint64)
    return tuple(_scratch[x][:n] for x in ("power", "inverse", "work", "total"))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def passes(texts: list[str | None], budget: int = PASS_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive runs of about `budget` bytes of encoded texts (null: empty) with the index of the first."""
    run: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass") if text else b""
        if run and size + len(data) > budget:
            yield first, run
            run, first, size = [], i, 0
        run.append(data)
        size += len(data) + 1
    if run:
        yield first, run


def word_hashes(run: list[bytes], word: bytes = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds): words of text i are hashes[bounds[i]:bounds[i + 1]]."""
    data = b"\n".join(run) + b"\n"
    raw = np.frombuffer(data.translate(LOWER), np.uint8)
    isword = np.frombuffer(b"\0" + data.translate(word), bool)
    edge = np.flatnonzero(isword[1:] != isword[:-1])
    starts, ends = edge[::2], edge[1::2]
    power, inverse, work, total = _buffers(len(raw) + 1)
    np.take(_BYTE, raw, out=work[:-1], mode="clip")
    np.multiply(work[:-1], power[:-1], out=work[:-1])
    np.cumsum(work[:-1], out=total[1:])
    hashes = (total[ends] - total[starts]) * inverse[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64))
    at = np.zeros(len(run) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in run], out=at[1:])
    return hashes, np.searchsorted(starts, at)


def run_shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of the k-word shingles of each text of a run; fewer words make one
    shingle, none make none."""
    n = len(hashes)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k if n >= k else 0):
        rolled += hashes[j : n - k + 1 + j] * _ROLL[j]
    rolled = mix(rolled + np.uint64(k))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out = np.sort(rolled[a : b - k + 1])
            if len(out) > 1:
                fresh = np.empty(len(out), bool)
                fresh[0] = True
                np.not_equal(out[1:], out[:-1], out=fresh[1:])
                out = out[fresh]
            yield out
        elif b > a:
            yield mix((hashes[a:b] * _ROLL[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield hashes[:0]


def set_hash(values: np.ndarray) -> int:
    """A signed 64-bit name of a set of hashes, given as sorted distinct values."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)
