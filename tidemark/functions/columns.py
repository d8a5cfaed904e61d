"""Whole columns of bytes at once: varints, message fields and ragged gathers as array operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import codecs

#: zeros that a buffer must have behind its data, so that numbers can be read at any place of it
SLACK = 64


def binary(lengths: np.ndarray, data: np.ndarray | bytes, nulls: np.ndarray | None = None) -> pa.BinaryArray:
    """Values that lie one after the other in data; those of `nulls` are null."""
    ends = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    if ends[-1] >= 1 << 31:
        raise OverflowError("a batch has 2 GiB at most")
    valid = pa.py_buffer(np.packbits(~nulls, bitorder="little")) if nulls is not None and nulls.any() else None
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [valid, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def plain(values: pa.Array) -> pa.BinaryArray:
    """Text or bytes as binary of 32-bit offsets, null as empty."""
    values = values.cast(pa.binary())
    return values.fill_null(b"") if values.null_count else values


def flat(values: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, lengths) of a binary column without nulls."""
    _, ends, data = values.buffers()
    at = np.frombuffer(ends, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64) if len(values) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at[:-1], np.diff(at)


def content(values: pa.BinaryArray) -> memoryview:
    """The bytes of a binary column without nulls, one value after the other."""
    data, starts, lengths = flat(values)
    return memoryview(data)[starts[0] : starts[-1] + lengths[-1]] if len(values) else memoryview(b"")


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, nulls: np.ndarray | None = None) -> pa.BinaryArray:
    """The runs of bytes at starts, as a column."""
    if nulls is not None:
        lengths = np.where(nulls, 0, lengths)
    total = int(lengths.sum())
    if total > 256 * len(lengths):  # long runs are copied one by one
        some = memoryview(data)
        return binary(lengths, b"".join([some[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist())]), nulls)
    before = np.cumsum(lengths) - lengths
    return binary(lengths, data[np.repeat(starts - before, lengths) + np.arange(total)], nulls)


def mixed(chosen: np.ndarray, yes: pa.Array, no: pa.Array) -> pa.Array:
    """The next value of `yes` where chosen, else of `no`."""
    place = np.where(chosen, np.cumsum(chosen) - 1, len(yes) + np.cumsum(~chosen) - 1)
    return pa.concat_arrays([yes, no]).take(pa.array(place))


def join(*parts) -> pa.BinaryArray:
    return pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.binary()))


def put_uvarints(x: np.ndarray) -> pa.BinaryArray:
    rest, out, size = x.astype(np.uint64), np.zeros((len(x), 10), np.uint8), np.ones(len(x), np.int64)
    width = 0
    while True:
        out[:, width] = rest & np.uint64(127)
        rest = rest >> np.uint64(7)
        more = rest > 0
        out[more, width] |= 128
        size += more
        width += 1
        if not more.any():
            break
    return binary(size, out[:, :width][np.arange(width) < size[:, None]])


def get_uvarints(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, positions after them, whether they are numbers of 64 bits); data needs SLACK zeros behind it."""
    b = data[at]
    x, after, going = (b & 127).astype(np.uint64), at + 1, np.flatnonzero(b > 127)
    shift = 7
    while len(going) and shift < 70:
        b = data[after[going]]
        x[going] |= (b & 127).astype(np.uint64) << np.uint64(shift)
        after[going] += 1
        going = going[b > 127]
        shift += 7
    good = np.ones(len(at), bool)
    good[going] = False
    return x, after, good


def put_field(number: int, values: pa.BinaryArray | np.ndarray) -> pa.BinaryArray:
    """A message field of each value, bytes or whole numbers; empty and 0 are left out."""
    if isinstance(values, np.ndarray):
        there, parts = values != 0, [put_uvarints(values)]
        tag = codecs.put_uvarint(number << 3)
    else:
        lengths = flat(values)[2]
        there, parts = lengths > 0, [put_uvarints(lengths), values]
        tag = codecs.put_uvarint(number << 3 | 2)
    out = join(pa.scalar(tag, pa.binary()), *parts)
    return out if there.all() else pc.if_else(pa.array(there), out, pa.scalar(b"", pa.binary()))


def padded(data) -> np.ndarray:
    """A copy of bytes with SLACK zeros behind it."""
    out = np.zeros(len(data) + SLACK, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out


def compress(values: pa.BinaryArray, code: int) -> pa.BinaryArray:
    """Each value by a compressor.  Snappy leaves values below 15 bytes as they are, behind a length and a tag."""
    codec = codecs.COMPRESSORS[code]
    if codec is None:
        return values
    lengths = flat(values)[2]
    short = (lengths < 15) & (code == codecs.CODES["snappy"])
    long = pa.array([codec[0](v) for v in (values.filter(pa.array(~short)) if short.any() else values).to_pylist()], pa.binary())
    if not short.any():
        return long
    some, n = (values.filter(pa.array(short)), lengths[short]) if len(long) else (values, lengths)
    sizes = np.where(n > 0, 2, 1)  # an empty value is its length alone
    heads = np.stack([n, (n - 1) * 4], 1).astype(np.uint8)
    packed = join(binary(sizes, heads[np.arange(2) < sizes[:, None]]), some)
    return mixed(short, packed, long) if len(long) else packed


def decompress(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, raw: np.ndarray, nulls: np.ndarray, code: int) -> pa.BinaryArray:
    """The values whose payloads lie at starts, null where `nulls`; data needs SLACK zeros behind it."""
    codec = codecs.COMPRESSORS[code]
    if codec is None:
        return gather(data, starts, sizes, nulls)
    whole = nulls.copy()
    if code == codecs.CODES["snappy"]:  # one literal of up to 60 bytes
        whole |= (raw > 0) & (raw <= 60) & (sizes == raw + 2) & (data[starts] == raw) & (data[starts + 1] == (raw - 1) * 4)
    if whole.all():
        return gather(data, starts + 2, raw, nulls)
    some = memoryview(data)
    rest = pa.array([codec[1](bytes(some[a : a + n])) for a, n in zip(starts[~whole].tolist(), sizes[~whole].tolist())], pa.binary())
    return mixed(whole, gather(data, starts[whole] + 2, raw[whole], nulls[whole]), rest) if whole.any() else rest
