"""Byte codecs and checksums of the native formats, and pandas UDFs over them."""

from __future__ import annotations

import gzip
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def _crc_table(poly: int, bits: int) -> list[int]:
    table = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ (poly if c & 1 else 0)
        table.append(c & ((1 << bits) - 1))
    return table


#: bytes that are summed at once
_RUN = 1024


class _Crc:
    """A reflected CRC with all ones before and after.

    It is linear: what a byte adds depends on the byte and on how many follow, so a run of bytes is one look-up in
    a table by position and one exclusive or over what it finds; short data go byte by byte.
    """

    def __init__(self, poly: int, bits: int):
        self.table, self.bits, self.ones = _crc_table(poly, bits), bits, (1 << bits) - 1
        self.kind = np.uint32 if bits == 32 else np.uint64
        self._places: np.ndarray | None = None

    @property
    def places(self) -> np.ndarray:
        """places[j, b]: what byte b adds if j more bytes follow."""
        if self._places is None:
            table = np.array(self.table, self.kind)
            out = np.empty((_RUN, 256), self.kind)
            out[0] = table
            for j in range(1, _RUN):
                out[j] = out[j - 1] >> self.kind(8) ^ table[(out[j - 1] & self.kind(255)).astype(np.intp)]
            self._places = out
        return self._places

    def __call__(self, data: bytes) -> int:
        c = self.ones
        if len(data) < 48:
            table = self.table
            for b in data:
                c = c >> 8 ^ table[(c ^ b) & 255]
            return c ^ self.ones
        return int(self.many(np.frombuffer(data, np.uint8)[None])[0])

    def many(self, rows: np.ndarray) -> np.ndarray:
        """The CRCs of the rows of a matrix of bytes."""
        width, flat = self.bits // 8, self.places.reshape(-1)
        c = np.full(len(rows), self.ones, self.kind)
        for at in range(0, rows.shape[1], _RUN):
            part = rows[:, at : at + _RUN]
            n = part.shape[1]
            # the state so far is added to the first bytes; what of it lies beyond a short run moves on
            head = c.astype(self.kind).view(np.uint8).reshape(len(rows), width)
            k = min(n, width)
            if len(rows) >= 64:  # place by place: a small table each, for many rows
                turned = np.array(part.T, order="C")
                turned[:k] ^= head[:, :k].T
                c = c >> self.kind(8 * n) if n < width else np.zeros(len(rows), self.kind)
                for j in range(n):
                    c ^= self.places[n - 1 - j].take(turned[j])
                continue
            index = part.astype(np.intp)
            index[:, :k] ^= head[:, :k]
            index += np.arange(n - 1, -1, -1, dtype=np.intp) * 256
            c = np.bitwise_xor.reduce(flat[index], 1) ^ (c >> self.kind(8 * n) if n < width else self.kind(0))
        return c ^ self.kind(self.ones)

    def runs(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The CRCs of runs of bytes, those of one length together."""
        out = np.empty(len(starts), self.kind)
        for n in np.unique(lengths).tolist():
            where, step = np.flatnonzero(lengths == n), max(64, (1 << 21) // max(1, n))
            for at in range(0, len(where), step):
                some = where[at : at + step]
                if n > 256:
                    rows = np.stack([data[a : a + n] for a in starts[some].tolist()])
                else:
                    rows = data[starts[some][:, None] + np.arange(n)]
                out[some] = self.many(rows)
        return out

    def column(self, values: list[bytes | None]) -> list[int | None]:
        """The CRCs of many values, those of one length together."""
        out: list[int | None] = [None] * len(values)
        by: dict[int, list[int]] = {}
        for i, v in enumerate(values):
            if v is not None:
                by.setdefault(len(v), []).append(i)
        for n, where in by.items():
            step = max(64, (1 << 21) // max(1, n))
            for at in range(0, len(where), step):
                some = where[at : at + step]
                rows = np.frombuffer(b"".join(bytes(values[i]) for i in some), np.uint8).reshape(len(some), n)
                for i, c in zip(some, self.many(rows).tolist()):
                    out[i] = c
        return out


crc32c, crc64_iso = _Crc(0x82F63B78, 32), _Crc(0xD800000000000000, 64)


def fnv1_64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = h * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF ^ b
    return h


def fnv1_64_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The hashes of runs of bytes, those of one length together."""
    out = np.full(len(starts), 0xCBF29CE484222325, np.uint64)
    for n in np.unique(lengths).tolist():
        where = np.flatnonzero(lengths == n)
        h, at = out[where], starts[where]
        for j in range(n):
            h = h * np.uint64(0x100000001B3) ^ data[at + j]
        out[where] = h
    return out


def fnv1_64_many(values: list[bytes]) -> np.ndarray:
    """The hashes of many values, those of one length together."""
    out = np.zeros(len(values), np.uint64)
    lengths = np.array([len(v) for v in values], np.int64)
    for n in np.unique(lengths).tolist():
        where = np.flatnonzero(lengths == n)
        rows = np.frombuffer(b"".join(bytes(values[i]) for i in where.tolist()), np.uint8).reshape(len(where), n)
        h = np.full(len(where), 0xCBF29CE484222325, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) ^ rows[:, j]
        out[where] = h
    return out


def signed(x: int) -> int:
    """The bit pattern of an unsigned 64-bit number as a long."""
    return x - (1 << 64) if x >> 63 else x


def put_uvarint(x: int) -> bytes:
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def get_uvarint(data: bytes, at: int) -> tuple[int, int]:
    """(value, position after it); EOFError if data ends within, ValueError beyond 64 bits."""
    x = shift = 0
    while True:
        if at >= len(data):
            raise EOFError("the data ends within a number")
        b = data[at]
        at += 1
        x |= (b & 127) << shift
        if b < 128:
            return x, at
        shift += 7
        if shift > 63:
            raise ValueError("a number has more than 64 bits")


def lzw_compress(data: bytes) -> bytes:
    """LSB first, 8-bit literals, codes of 9 to 12 bits; 256 clears, 257 ends."""
    out, acc, n = bytearray(), 0, 0

    def emit(code: int, width: int) -> None:
        nonlocal acc, n
        acc |= code << n
        n += width
        while n >= 8:
            out.append(acc & 255)
            acc >>= 8
            n -= 8

    width, high, table, run = 9, 257, {}, None
    emit(256, width)
    for b in data:
        if run is None:
            run = b
        elif (run, b) in table:
            run = table[run, b]
        else:
            emit(run, width)
            high += 1
            if high == 1 << width:
                width += 1
            if high == 4095:
                emit(256, width if width <= 12 else 12)
                width, high, table = 9, 257, {}
            else:
                table[run, b] = high
            run = b
    if run is not None:
        emit(run, width)
        high += 1
        if high == 1 << width and width < 12:
            width += 1
    emit(257, width)
    if n:
        out.append(acc & 255)
    return bytes(out)


def lzw_decompress(data: bytes) -> bytes:
    out, acc, n, at = bytearray(), 0, 0, 0
    # the reader knows a code one step later than the writer, which widens as it assigns the code
    width, entries, last, code_next = 9, {}, None, 258
    while True:
        while n < width:
            if at >= len(data):
                raise EOFError("the data ends within a code")
            acc |= data[at] << n
            n += 8
            at += 1
        code = acc & ((1 << width) - 1)
        acc >>= width
        n -= width
        if code == 256:
            width, entries, last, code_next = 9, {}, None, 258
            continue
        if code == 257:
            return bytes(out)
        if code < 256:
            word = bytes((code,))
        elif code in entries:
            word = entries[code]
        elif last is not None and code == code_next:
            word = last + last[:1]
        else:
            raise ValueError("bad code")
        out += word
        if last is not None and code_next < 4096:
            entries[code_next] = last + word[:1]
            code_next += 1
        if code_next >= 1 << width and width < 12:
            width += 1
        last = word


_SNAPPY = pa.Codec("snappy")


def snappy_length(data: bytes) -> int:
    return get_uvarint(data, 0)[0]


def snappy_decompress(data: bytes) -> bytes:
    return _SNAPPY.decompress(data, snappy_length(data)).to_pybytes()


#: code in the file header -> (compress, decompress)
COMPRESSORS: dict[int, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]] | None] = {
    0: None,
    1: (lambda x: gzip.compress(x, mtime=0), gzip.decompress),
    2: (lambda x: _SNAPPY.compress(x).to_pybytes(), snappy_decompress),
    3: (lzw_compress, lzw_decompress),
}
CODES = {"none": 0, "gzip": 1, "snappy": 2, "lzw": 3}


def _column(f: Callable[[list[bytes | None]], list[int | None]]):
    @F.pandas_udf(LongType())
    def apply(values: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else signed(x) for x in f(list(values))], dtype="Int64")

    return apply


crc64_iso_udf, crc32c_udf = _column(crc64_iso.column), _column(crc32c.column)


def _fnv(values: list[bytes | None]) -> list[int | None]:
    known = iter(fnv1_64_many([v for v in values if v is not None]).tolist())
    return [None if v is None else next(known) for v in values]


fnv1_64_udf = _column(_fnv)


class Bloom:
    """A Bloom filter over FNV-1 hashes of keys, sized for n keys at a false positive rate of p."""

    def __init__(self, n: int = 1000, p: float = 0.01):
        if n <= 0:
            raise ValueError("the expected number of keys must be positive")
        self.size = max(64, int(-n * np.log(p) / np.log(2) ** 2) + 1)
        self.hashes = max(1, round(self.size / n * np.log(2)))
        self.bits = np.zeros(self.size, bool)

    def _places(self, key: bytes) -> list[int]:
        return self._spread(fnv1_64(key), self.size, self.hashes)

    @staticmethod
    def _spread(h: int, size: int, hashes: int) -> list[int]:
        step = (h >> 33 | h << 31 & 0xFFFFFFFFFFFFFFFF) | 1
        return [(h + i * step) % size for i in range(hashes)]

    @classmethod
    def asked(cls, data: bytes, h: int) -> bool:
        """Whether a dumped filter has the key of that FNV-1 hash; only its own bits are looked at."""
        size, hashes = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
        return all(data[16 + (at >> 3)] >> (7 - (at & 7)) & 1 for at in cls._spread(h, size, hashes))

    def add_hashes(self, hashes: np.ndarray) -> None:
        step = (hashes >> np.uint64(33) | hashes << np.uint64(31)) | np.uint64(1)
        for i in range(self.hashes):
            # as in _places, without the overflow of 64 bits
            size = np.uint64(self.size)
            self.bits[(hashes % size + np.uint64(i) * (step % size)) % size] = True

    def add(self, key: bytes) -> None:
        self.bits[self._places(key)] = True

    def __contains__(self, key: bytes) -> bool:
        return bool(self.bits[self._places(key)].all())

    def dump(self) -> bytes:
        """Bits and hashes as two 8-byte numbers, then the bits, packed."""
        return self.size.to_bytes(8, "little") + self.hashes.to_bytes(8, "little") + np.packbits(self.bits).tobytes()

    @classmethod
    def load(cls, data: bytes) -> Bloom:
        out = cls.__new__(cls)
        out.size, out.hashes = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
        out.bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=16), count=out.size).astype(bool)
        return out
