"""The native record files, logs and sorted tables as Spark data sources.

A record file is an 8-byte header (format version, compressor code; little-endian) and records: magic number,
nil flag (versions 3 and 4), uncompressed and compressed length, header checksum (version 4), payload.  See
tidemark.functions.codecs for the codecs.  `register(spark)` adds the formats `records`, `log` and
`sortedtable`.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition, LessThanOrEqual, WriterCommitMessage

from ..functions import codecs, columns

MAGIC = 0x130691
HEAD = 8


class RecordError(ValueError):
    """The file isn't what it should be: MAGIC, CHECKSUM, VERSION, COMPRESSION or TORN."""

    def __init__(self, kind: str, offset: int):
        super().__init__(f"{kind} at byte {offset}")
        self.kind, self.offset = kind, offset

    def __reduce__(self):
        return RecordError, (self.kind, self.offset)


def open_head(data: bytes) -> tuple[int, int]:
    """(version, compressor code) of a file's first bytes."""
    if len(data) < HEAD:
        raise RecordError("TORN", 0)
    version, code = struct.unpack("<II", data[:HEAD])
    if not 1 <= version <= 4:
        raise RecordError("VERSION", 0)
    if code not in codecs.COMPRESSORS:
        raise RecordError("COMPRESSION", 4)
    return version, code


_MARK = codecs.put_uvarint(MAGIC)


def _quick(data: bytes, at: int, code: int) -> tuple[bytes | None, int] | None:
    """What read_at returns for a whole record of version 4, or None if anything is odd, which read_at then tells."""
    head = data[at : at + 40]
    if head[:3] != _MARK:
        return None
    numbers, i = [], 4
    try:
        for _ in range(3):
            x = shift = 0
            while (b := head[i]) > 127:
                x |= (b & 127) << shift
                shift += 7
                i += 1
            numbers.append(x | b << shift)
            i += 1
            if len(numbers) == 2:
                end = i
    except IndexError:
        return None
    raw, packed, want = numbers
    if codecs.crc32c(head[:end]) != want:
        return None
    if head[3] == 1:
        return None, at + i
    codec = codecs.COMPRESSORS[code]
    size = packed if codec else raw
    payload = data[at + i : at + i + size]
    if len(payload) != size or not size and at + i >= len(data):
        return None
    return (codec[1](payload) if codec else payload), at + i + size


def read_at(data: bytes, at: int, version: int, code: int, skip: bool = False) -> tuple[bytes | None, int]:
    """(record or None for nil, position after it); EOFError if the data ends within its header."""
    start = at
    if version == 1:
        if at + 20 > len(data):
            raise EOFError
        magic, raw, packed = struct.unpack_from("<IQQ", data, at)
        at, nil = at + 20, False
        if magic != MAGIC:
            raise RecordError("MAGIC", start)
    else:
        quick = _quick(data, at, code) if version == 4 else None
        if quick is not None and not skip:
            return quick
        magic, at = codecs.get_uvarint(data, at)
        if magic != MAGIC:
            raise RecordError("MAGIC", start)
        nil = False
        if version >= 3:
            if at >= len(data):
                raise EOFError
            nil, at = data[at] == 1, at + 1
        raw, at = codecs.get_uvarint(data, at)
        packed, at = codecs.get_uvarint(data, at)
        if version == 4:
            want = codecs.crc32c(data[start:at])
            got, at = codecs.get_uvarint(data, at)
            if got != want:
                raise RecordError("CHECKSUM", start)
    if nil:
        return None, at
    codec = codecs.COMPRESSORS[code]
    size = packed if codec else raw
    if at + size > len(data):
        if at == len(data):
            raise EOFError
        raise RecordError("TORN", start)
    if skip:
        return b"", at + size
    payload = data[at : at + size]
    return (codec[1](payload) if codec else payload), at + size


def read_records(data: bytes, at: int = HEAD, end: int | None = None, skip: int = 0, tolerate_torn_tail: bool = False) -> Iterator[tuple[int, bytes | None]]:
    """(offset, record) from a position on, up to records that start at `end` or later.  Zeros up to the end of the
    file are padding; a header that the file ends in is its end."""
    version, code = open_head(data)
    while at < len(data) and (end is None or at < end):
        got = _next(data, at, version, code, skip > 0, tolerate_torn_tail)
        if got is None:
            return
        if skip > 0:
            skip -= 1
        else:
            yield at, got[0]
        at = got[1]


def _next(data: bytes, at: int, version: int, code: int, skip: bool = False, tolerate_torn_tail: bool = False) -> tuple[bytes | None, int] | None:
    """What read_at returns, or None where the records end."""
    try:
        return read_at(data, at, version, code, skip)
    except EOFError:
        return None
    except RecordError as e:
        if e.kind == "MAGIC" and not any(data[at:]):
            return None
        if e.kind == "TORN" and tolerate_torn_tail:
            return None
        raise


#: bytes of a file that are looked at together
WINDOW = 4 << 20


class _Heads:
    """The headers of version 4 at given places of a buffer (SLACK zeros behind its n bytes), and which of them begin a
    record that lies in the buffer as a whole."""

    def __init__(self, data: np.ndarray, n: int, at: np.ndarray, code: int):
        self.data, self.code, self.start = data, code, at
        marked = (data[at] == _MARK[0]) & (data[at + 1] == _MARK[1]) & (data[at + 2] == _MARK[2])
        self.nil = data[at + 3] == 1
        raw, end, good = columns.get_uvarints(data, at + 4)
        packed, end, fine = columns.get_uvarints(data, end)
        want, self.payload, whole = columns.get_uvarints(data, end)
        size = np.where(self.nil, 0, packed if codecs.COMPRESSORS[code] else raw)
        self.whole = marked & good & fine & whole & (self.payload <= n) & (size <= n)
        self.raw, self.size = (np.minimum(x, n).astype(np.int64) for x in (raw, size))
        self.end = self.payload + self.size
        self.whole &= self.end <= n
        some = np.flatnonzero(self.whole)
        self.whole[some] = codecs.crc32c.runs(data, at[some], end[some] - at[some]) == want[some]

    def values(self, some: np.ndarray | slice) -> pa.BinaryArray:
        return columns.decompress(self.data, self.payload[some], self.size[some], self.raw[some], self.nil[some], self.code)


def record_columns(data: bytes, at: int = HEAD, end: int | None = None, skip: int = 0, tolerate_torn_tail: bool = False) -> Iterator[tuple[np.ndarray, pa.BinaryArray]]:
    """What read_records gives, as columns of offsets and records.  In a window of the file, whole records of version 4
    are found by their magic number and checksum, and each must begin where the one before ends; what else stands there
    is read one by one."""
    version, code = open_head(data)
    if version < 4 or skip:
        yield from _one_by_one(read_records(data, at, end, skip, tolerate_torn_tail))
        return
    stop = len(data) if end is None else min(end, len(data))
    while at < stop:
        n = min(WINDOW, len(data) - at)
        some = columns.padded(data[at : at + n])
        marks = np.flatnonzero((some[:n] == _MARK[0]) & (some[1 : n + 1] == _MARK[1]) & (some[2 : n + 2] == _MARK[2]))
        heads = _Heads(some, n, marks[marks < stop - at], code)
        found = np.flatnonzero(heads.whole)
        if not len(found) or heads.start[found[0]] or (heads.end[found[:-1]] != heads.start[found[1:]]).any():
            place, chain, here = dict(zip(heads.start[found].tolist(), found.tolist())), [], 0
            while here in place:  # a payload may hold what looks like a record
                chain.append(place[here])
                here = int(heads.end[chain[-1]])
            found = np.array(chain, np.int64)
        if len(found):
            try:
                values = heads.values(found)
            except Exception:  # noqa: BLE001 - a payload can't be unpacked: reading on to it tells
                yield from _one_by_one(read_records(data, at, end, 0, tolerate_torn_tail))
                return
            yield at + heads.start[found], values
            at += int(heads.end[found[-1]])
            continue
        got = _next(data, at, version, code, False, tolerate_torn_tail)
        if got is None:
            return
        yield np.array([at], np.int64), pa.array([got[0]], pa.binary())
        at = got[1]


def _one_by_one(records: Iterator[tuple[int, bytes | None]]) -> Iterator[tuple[np.ndarray, pa.BinaryArray]]:
    from itertools import batched

    for part in batched(records, 8192):
        offsets, values = zip(*part)
        yield np.array(offsets, np.int64), pa.array(values, pa.binary())


def values_at(data: bytes, offsets: np.ndarray, version: int, code: int) -> pa.BinaryArray:
    """The records at given offsets; those that follow one another in a window are read together."""
    parts, i = [], 0
    while i < len(offsets):
        first = int(offsets[i])
        near = offsets[i : i + 50_000 if version == 4 else i + 1] - first
        near = near[: int(np.argmax(np.append((near < 0) | (near >= WINDOW) | (first < HEAD), True)))]
        if version == 4 and len(near) > 1:
            n = min(int(near.max()) + (64 << 10), len(data) - first)
            heads = _Heads(columns.padded(data[first : first + n]), n, near[near < n], code) if n > 0 else None
            good = int(np.argmin(np.append(heads.whole, False))) if heads is not None else 0
            if good:
                parts.append(heads.values(slice(0, good)))
                i += good
                continue
        parts.append(pa.array([read_at(data, first, version, code)[0]], pa.binary()))
        i += 1
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def seek(data: bytes, at: int) -> tuple[int, bytes | None] | None:
    """The first whole record that starts at or after a position (versions 2 and later), or None."""
    version, code = open_head(data)
    if version < 2:
        raise ValueError("version 1 files can't be searched")
    mark, at = codecs.put_uvarint(MAGIC), max(at, HEAD)
    while (at := data.find(mark, at)) >= 0:
        try:
            return at, read_at(data, at, version, code)[0]
        except (RecordError, EOFError, ValueError, OSError):
            at += 1
    return None


def put_record(record: bytes | None, code: int) -> bytes:
    codec = codecs.COMPRESSORS[code]
    raw = record or b""
    payload = codec[0](raw) if codec else raw
    head = codecs.put_uvarint(MAGIC) + bytes((record is None,)) + codecs.put_uvarint(len(raw)) + codecs.put_uvarint(len(payload) if codec else 0)
    head += codecs.put_uvarint(codecs.crc32c(head))
    return head if record is None else head + payload


_MARKS = pa.array([_MARK + bytes((nil,)) for nil in (0, 1)], pa.binary())


def put_records(values: pa.BinaryArray, code: int) -> pa.BinaryArray:
    """put_record of each value."""
    nil, raw = values.is_null(), columns.plain(values)
    payload = columns.compress(raw, code)
    sizes = columns.flat(payload)[2] if codecs.COMPRESSORS[code] else np.zeros(len(values), np.int64)
    head = columns.join(_MARKS.take(nil.cast(pa.int8())), columns.put_uvarints(columns.flat(raw)[2]), columns.put_uvarints(sizes))
    checks = columns.put_uvarints(codecs.crc32c.runs(*columns.flat(head)))
    return columns.join(head, checks, pc.if_else(nil, pa.scalar(b"", pa.binary()), payload) if values.null_count else payload)


def _pieces(batches, most: int = 16 << 20):
    """Batches cut so that none has much more bytes."""
    for batch in batches:
        step = max(1, batch.num_rows * most // max(most, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _runs(column: pa.Array) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each run of equal numbers."""
    if column.null_count:
        raise ValueError("a number of a segment or table is null")
    x = column.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)] if len(x) else []
    for a, b in zip(cuts, cuts[1:]):
        yield int(x[a]), a, b


def _joined(batches, rows: int = 8192, most: int = 4 << 20):
    """Batches put together up to about so many rows or bytes."""
    some, n, size = [], 0, 0
    for batch in batches:
        some.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= rows or size >= most:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()
            some, n, size = [], 0, 0
    if some:
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()


def file_head(code: int) -> bytes:
    return struct.pack("<II", 4, code)


def _files(path: str, pattern: str) -> list[str]:
    if not path:
        raise ValueError("a path is needed")
    if os.path.isdir(path):
        return sorted(glob.glob(os.path.join(path, pattern)))
    return sorted(glob.glob(path)) if glob.has_magic(path) else [path]


class _Span(InputPartition):
    def __init__(self, path: str, start: int, end: int | None, seq: int = 0):
        self.path, self.start, self.end, self.seq = path, start, end, seq


class _Group(InputPartition):
    """Files (path, number) that one task reads one after the other."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def _grouped(files: list[tuple[str, int]], sizes: list[int]) -> list[_Group]:
    """Files in order, in tasks of about 1/128 of all, but 2 MiB at least and 32 MiB at most, where opening one counts as
    64 KiB; a larger file is a task of its own."""
    cost = [n + (64 << 10) for n in sizes]
    most = min(32 << 20, max(2 << 20, sum(cost) // 128))
    groups, held = [], 0
    for file, n in zip(files, cost):
        if not groups or held + n > most:
            groups.append(_Group([]))
            held = 0
        groups[-1].files.append(file)
        held += n
    return groups or [_Group([])]


class _RecordReader(DataSourceReader):
    """One task per span of a file.  Only version 4 is split: a span begins at the first whole record in it, which
    the header checksum proves."""

    def __init__(self, options: dict, pattern: str):
        self.paths = _files(options.get("path", ""), options.get("pattern", pattern))
        self.split = int(options.get("splitbytes", 64 << 20))
        self.skip = int(options.get("skip", 0))
        self.torn = options.get("toleratetorntail", "false").lower() == "true"
        self.exact: int | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("offset",):
                self.exact = f.value
            yield f  # Spark checks again

    def partitions(self):
        spans = []
        for path in self.paths:
            size = os.path.getsize(path)
            with open(path, "rb") as file:
                version, _ = open_head(file.read(HEAD))
            if version < 4 or self.skip or size <= self.split or self.exact is not None:
                spans.append(_Span(path, HEAD, None))
            else:
                cuts = [*range(0, size, self.split), size]
                spans += [_Span(path, max(HEAD, a), b) for a, b in zip(cuts, cuts[1:])]
        return spans or [_Span("", 0, 0)]

    def read(self, span):
        if not span.path:
            return
        import mmap

        with open(span.path, "rb") as file, mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) as mapped:
            data = mapped  # sliced and searched as bytes are, without a copy of the file
            at = span.start
            if self.exact is not None:
                try:
                    version, code = open_head(data)
                    if HEAD <= self.exact < len(data):
                        yield span.path, self.exact, read_at(data, self.exact, version, code)[0]  # rows or batches, never both
                except (RecordError, EOFError):
                    return
                return
            if at > HEAD:
                found = seek(data, at)
                if found is None:
                    return
                at = found[0]
            for offsets, values in record_columns(data, at, span.end, self.skip, self.torn):
                yield pa.RecordBatch.from_arrays([pa.repeat(span.path, len(values)), pa.array(offsets), values], names=["file", "offset", "record"])


class _RecordWriter(DataSourceArrowWriter):
    """One file per task, renamed into place when all tasks are done; no file is ever overwritten."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.code = options["path"], codecs.CODES[options.get("compression", "none")]
        if overwrite:
            raise ValueError("record files are only ever appended to a folder")

    def write(self, iterator):
        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f".part-{uuid.uuid4().hex}")
        with open(name, "xb") as file:
            file.write(file_head(self.code))
            for batch in _pieces(iterator):
                file.write(columns.content(put_records(batch.column("record").cast(pa.binary()), self.code)))
            file.flush()
            os.fsync(file.fileno())
        message = WriterCommitMessage()
        message.name = name
        return message

    def commit(self, messages):
        for i, m in enumerate(m for m in messages if m is not None):
            os.rename(m.name, os.path.join(self.path, f"{i:06d}-{os.path.basename(m.name)[6:]}.rio"))

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.name):
                os.remove(m.name)


class RecordSource(DataSource):
    """Options: path (file, folder or glob), pattern, skip, splitBytes, tolerateTornTail; compression to write."""

    @classmethod
    def name(cls):
        return "records"

    def schema(self):
        return "file string, offset long, record binary"

    def reader(self, schema):
        return _RecordReader(self.options, "*.rio")

    def writer(self, schema, overwrite):
        return _RecordWriter(self.options, overwrite)


class _LogReader(DataSourceReader):
    """Segments in the order of their names, small ones together in a task; ordinal counts within a segment."""

    def __init__(self, options: dict):
        self.paths = _files(options.get("path", ""), "*.wal")
        self.torn = options.get("toleratetorntail", "false").lower() == "true"

    def partitions(self):
        return _grouped([(p, i) for i, p in enumerate(self.paths)], [os.path.getsize(p) for p in self.paths])

    def read(self, group):
        return _joined(batch for path, seq in group.files for batch in self._segment(path, seq))

    def _segment(self, path, seq):
        import mmap

        name, n = os.path.basename(path), 0
        with open(path, "rb") as file, mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) as data:
            for _, values in record_columns(data, tolerate_torn_tail=self.torn):
                numbers = pa.array(np.arange(n, n + len(values)))
                yield pa.RecordBatch.from_arrays([pa.repeat(name, len(values)), pa.repeat(pa.scalar(seq, pa.int32()), len(values)), numbers, values], names=["file", "segment", "ordinal", "record"])
                n += len(values)


class _LogWriter(_RecordWriter):
    """Rows (segment, record) whose segments come one after the other in each task: a file of that number for each;
    a segment that exists or that two tasks write is an error."""

    def write(self, iterator):
        os.makedirs(self.path, exist_ok=True)
        message = WriterCommitMessage()
        message.names = []
        file = last = None
        try:
            for batch in _pieces(iterator):
                records = put_records(batch.column("record").cast(pa.binary()), self.code)
                for segment, a, b in _runs(batch.column("segment")):
                    if segment != last:
                        self._end(file)
                        name = os.path.join(self.path, f".{segment:06d}-{uuid.uuid4().hex}")
                        file, last = open(name, "xb"), segment
                        file.write(file_head(self.code))
                        message.names.append((name, os.path.join(self.path, f"{segment:06d}.wal")))
                    file.write(columns.content(records[a:b]))
            self._end(file)
        finally:
            if file:
                file.close()
        return message

    @staticmethod
    def _end(file) -> None:
        if file:
            file.flush()
            os.fsync(file.fileno())
            file.close()

    def commit(self, messages):
        names = [x for m in messages if m is not None for x in m.names]
        for name, final in names:
            os.link(name, final)  # fails if it exists
        for name, _ in names:
            os.remove(name)

    def abort(self, messages):
        for m in messages:
            for name, _ in m.names if m is not None else ():
                if os.path.exists(name):
                    os.remove(name)


class LogSource(DataSource):
    """A folder of numbered log segments; (segment, ordinal) is the replay order."""

    @classmethod
    def name(cls):
        return "log"

    def schema(self):
        return "file string, segment int, ordinal long, record binary"

    def reader(self, schema):
        return _LogReader(self.options)

    def writer(self, schema, overwrite):
        return _LogWriter(self.options, overwrite)


# --- protobuf fields, as far as the formats need them


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message: whole numbers or bytes."""
    at = 0
    while at < len(data):
        tag, at = codecs.get_uvarint(data, at)
        if tag & 7 == 0:
            value, at = codecs.get_uvarint(data, at)
        elif tag & 7 == 2:
            n, at = codecs.get_uvarint(data, at)
            value, at = data[at : at + n], at + n
        elif tag & 7 in (1, 5):
            n = 8 if tag & 7 == 1 else 4
            value, at = int.from_bytes(data[at : at + n], "little"), at + n
        else:
            raise ValueError("unknown field type")
        yield tag >> 3, value


def put_field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return codecs.put_uvarint(number << 3) + codecs.put_uvarint(value) if value else b""
    return codecs.put_uvarint(number << 3 | 2) + codecs.put_uvarint(len(value)) + value if value else b""


class ChecksumError(ValueError):
    pass


class _TableReader(DataSourceReader):
    """Table folders in the order of names (gen is the ordinal), small ones together in a task.  Keys are in the index,
    so a pushed key range is met before any value is read."""

    def __init__(self, options: dict):
        path = options.get("path", "")
        if not path:
            raise ValueError("a path is needed")
        self.paths = [path] if os.path.exists(os.path.join(path, "index.rio")) else sorted(os.path.dirname(p) for p in glob.glob(os.path.join(path, "*", "index.rio")))
        self.check = options.get("checkvalues", "true").lower() == "true"
        self.low: bytes | None = None
        self.high: bytes | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThanOrEqual)) and f.attribute == ("key",):
                self.low = max(self.low or b"", bytes(f.value))
            if isinstance(f, (EqualTo, LessThanOrEqual)) and f.attribute == ("key",):
                self.high = bytes(f.value) if self.high is None else min(self.high, bytes(f.value))
            yield f

    def partitions(self):
        sizes = [sum(os.path.getsize(os.path.join(p, name)) for name in ("index.rio", "data.rio")) for p in self.paths]
        return _grouped([(p, i) for i, p in enumerate(self.paths)], sizes)

    def read(self, group):
        wanted = codecs.fnv1_64(self.low) if self.low is not None and self.low == self.high else None
        return _joined(batch for path, seq in group.files if wanted is None or self._may_have(path, wanted) for batch in self._table(path, seq))

    @staticmethod
    def _may_have(path, wanted: int) -> bool:
        try:
            with open(os.path.join(path, "bloom.bin"), "rb") as file:
                return codecs.Bloom.asked(file.read(), wanted)
        except FileNotFoundError:
            return True

    def _table(self, path, seq):
        import mmap

        meta = os.path.join(path, "meta.pb.bin")
        version = 0
        if os.path.exists(meta):
            with open(meta, "rb") as file:
                version = dict(fields(file.read())).get(7, 0)
        with open(os.path.join(path, "index.rio"), "rb") as file:
            index = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        with open(os.path.join(path, "data.rio"), "rb") as file:
            mapped = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        form, code = open_head(mapped)
        with index, mapped:
            for _, entries in record_columns(index, self._first(index)):
                keys, offsets, wanted = _entries(entries)
                beyond = False
                if self.high is not None:
                    over = pc.greater(keys, pa.scalar(self.high, pa.binary())).to_numpy(zero_copy_only=False)
                    if beyond := bool(over.any()):
                        n = int(np.argmax(over))
                        keys, offsets, wanted = keys[:n], offsets[:n], wanted[:n]
                if self.low is not None:
                    kept = pc.greater_equal(keys, pa.scalar(self.low, pa.binary())).to_numpy(zero_copy_only=False).astype(bool)
                    keys, offsets, wanted = keys.filter(pa.array(kept)), offsets[kept], wanted[kept]
                step = 8192
                for at in range(0, len(keys), step):
                    yield from self._batches(path, seq, keys[at : at + step], offsets[at : at + step], wanted[at : at + step], mapped, form, code, version)
                if beyond:
                    return

    def _batches(self, path, seq, keys, offsets, wanted, mapped, form, code, version):
        """Rows of some keys, of about 4 MiB of the file each."""
        far = np.flatnonzero((offsets - offsets[0]) // WINDOW != np.append(0, offsets[:-1] - offsets[0]) // WINDOW).tolist()
        for a, b in zip([0, *far], [*far, len(keys)]):
            if a == b:
                continue
            values = values_at(mapped, offsets[a:b], form, code)
            if version == 0:  # older tables wrap values in a message
                values = pa.array([None if v is None else dict(fields(v)).get(1, b"") for v in values.to_pylist()], pa.binary())
            yield self._batch(path, seq, keys[a:b], values, offsets[a:b], wanted[a:b])

    def _first(self, index) -> int:
        """A position in the index at or before the first key from the lower bound on, by bisection of its bytes."""
        first, last = HEAD, len(index)
        if self.low is None or open_head(index)[0] < 4:
            return first
        while last - first > 1 << 16:
            middle = (first + last) // 2
            found = seek(index, middle)
            if found is None or found[0] >= last or dict(fields(found[1] or b"")).get(1, b"") >= self.low:
                last = middle
            else:
                first = found[0]
        return first

    def _batch(self, path, seq, keys, values, offsets, wanted):
        if self.check:
            got = codecs.crc64_iso.runs(*columns.flat(columns.plain(values)))
            for i in np.flatnonzero((wanted != 0) & (got != wanted))[:1].tolist():
                raise ChecksumError(f"the value of key {keys[i].as_py().hex()} at byte {offsets[i]} of {path} isn't the one written")
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(seq, pa.int64()), len(keys)), keys, values, pa.array(offsets), pa.array(wanted.view(np.int64))], names=["gen", "key", "value", "value_offset", "checksum"])


def _entries(entries: pa.BinaryArray) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """(keys, offsets, checksums) of index records."""
    raw = columns.plain(entries)
    data, at, sizes = columns.flat(raw)
    data, end = columns.padded(data), at + sizes
    n, key, good = columns.get_uvarints(data, at + 1)
    good &= (sizes > 0) & (data[at] == 10) & (n > 0) & (n <= sizes)
    size = np.where(good, n, 0).astype(np.int64)
    after = np.where(good, key + size, 0)
    good &= after < end
    after = np.where(good, after, 0)
    offset, more, fine = columns.get_uvarints(data, after + 1)
    good &= (data[after] == 16) & fine & (more <= end)
    there = more < end  # a checksum, unless it is 0
    more = np.where(good, more, 0)
    check, last, fine = columns.get_uvarints(data, more + 1)
    good &= ~there | (data[more] == 24) & fine & (last == end)
    if good.all():
        return columns.gather(data, key, size), offset.astype(np.int64), np.where(there, check, np.uint64(0))
    parts = [dict(fields(e)) for e in raw.to_pylist()]
    return pa.array([p.get(1, b"") for p in parts], pa.binary()), np.array([p.get(2, 0) for p in parts], np.int64), np.array([p.get(3, 0) for p in parts], np.uint64)


class _TableWriter(DataSourceArrowWriter):
    """Rows (gen, key, value) whose gens come one after the other in each task, keys ascending: a table folder for each
    gen; a gen that exists or that two tasks write is an error."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.compression = options["path"], options.get("compression", "snappy")
        if overwrite:
            raise ValueError("tables are only ever added to a folder")

    def write(self, iterator):
        os.makedirs(self.path, exist_ok=True)
        message = WriterCommitMessage()
        message.names = []
        table = last = None
        try:
            for batch in _pieces(iterator):
                keys, values = batch.column("key"), batch.column("value").cast(pa.binary())
                if keys.null_count:
                    raise ValueError("a key is null")
                keys = columns.plain(keys)
                for gen, a, b in _runs(batch.column("gen")):
                    if gen != last:
                        if table:
                            table.finish()
                        name = os.path.join(self.path, f".gen-{uuid.uuid4().hex}")
                        table, last = _TableFile(name, self.compression), gen
                        message.names.append((name, os.path.join(self.path, f"gen_{gen:015d}")))
                    table.add(keys[a:b], values[a:b])
            if table:
                table.finish()
        finally:
            if table:
                table.close()
        return message

    def commit(self, messages):
        for name, final in [x for m in messages if m is not None for x in m.names]:
            os.rename(name, final)  # fails if it exists, as no table folder is empty

    def abort(self, messages):
        import shutil

        for m in messages:
            for name, _ in m.names if m is not None else ():
                shutil.rmtree(name, ignore_errors=True)


class TableSource(DataSource):
    """Sorted-table folders.  Options: path (a table or a folder of tables), checkValues."""

    @classmethod
    def name(cls):
        return "sortedtable"

    def schema(self):
        return "gen long, key binary, value binary, value_offset long, checksum long"

    def reader(self, schema):
        return _TableReader(self.options)

    def writer(self, schema, overwrite):
        return _TableWriter(self.options, overwrite)


def save_tables(df, path: str, compression: str = "snappy") -> None:
    """Native tables of a relation (gen, key binary, value binary), one per gen, each written by one task; gens side by
    side.  A large table is a gen per key range."""
    rows = df.select("gen", "key", "value").repartition("gen").sortWithinPartitions("gen", "key")
    rows.write.format("sortedtable").option("compression", compression).mode("append").save(path)


def write_table(path: str, rows, compression: str = "snappy", rate: float = 0.01) -> dict:
    """One native table from (key, value) rows in ascending order; a repeated or descending key is an error.  Beside it
    stands a Bloom filter of its keys, bloom.bin, sized for them."""
    from itertools import batched

    table = _TableFile(path, compression, rate)
    try:
        for part in batched(rows, 1024):
            keys, values = zip(*part)
            table.add(pa.array(keys, pa.binary()), pa.array(values, pa.binary()))
        return table.finish()
    finally:
        table.close()


class _TableFile:
    """A native table that columns of keys, ascending, and values are added to."""

    def __init__(self, path: str, compression: str, rate: float = 0.01):
        os.makedirs(path)
        self.path, self.code, self.rate = path, codecs.CODES[compression], rate
        self.n, self.nulls, self.offset, self.low, self.last, self.hashes = 0, 0, HEAD, None, None, []
        self.data, self.index = (open(os.path.join(path, name), "xb") for name in ("data.rio", "index.rio"))
        self.data.write(file_head(self.code))
        self.index.write(file_head(0))

    def add(self, keys: pa.BinaryArray, values: pa.BinaryArray) -> None:
        if not len(keys):
            return
        before = keys[:-1] if self.last is None else pa.concat_arrays([pa.array([self.last], pa.binary()), keys[:-1]])
        after = keys[1:] if self.last is None else keys
        if pc.any(pc.equal(after, before)).as_py():
            raise ValueError("a key can be written only once")
        if pc.any(pc.less(after, before)).as_py():
            raise ValueError("keys must ascend")
        records = put_records(values, self.code)
        sizes = columns.flat(records)[2]
        offsets = self.offset + np.cumsum(sizes) - sizes
        checks = codecs.crc64_iso.runs(*columns.flat(columns.plain(values)))
        self.data.write(columns.content(records))
        entries = columns.join(columns.put_field(1, keys), columns.put_field(2, offsets), columns.put_field(3, checks))
        self.index.write(columns.content(put_records(entries, 0)))
        self.offset += int(sizes.sum())
        self.low, self.last = keys[0].as_py() if self.low is None else self.low, keys[-1].as_py()
        self.n, self.nulls = self.n + len(keys), self.nulls + values.null_count
        self.hashes.append(codecs.fnv1_64_runs(*columns.flat(keys)))

    def finish(self) -> dict:
        sizes = self.data.tell(), self.index.tell()
        self.close()
        bloom = codecs.Bloom(max(1, self.n), self.rate)
        for h in self.hashes:
            bloom.add_hashes(h)
        with open(os.path.join(self.path, "bloom.bin"), "xb") as file:
            file.write(bloom.dump())
        meta = put_field(1, self.n) + put_field(2, self.low or b"") + put_field(3, self.last or b"") + put_field(4, sizes[0]) + put_field(5, sizes[1]) + put_field(6, sum(sizes)) + put_field(7, 1) + put_field(9, self.nulls)
        with open(os.path.join(self.path, "meta.pb.bin"), "xb") as file:
            file.write(meta)
        return {"num_records": self.n, "null_values": self.nulls, "min_key": self.low, "max_key": self.last, "data_bytes": sizes[0], "index_bytes": sizes[1], "total_bytes": sum(sizes), "bloom": bloom}

    def close(self) -> None:
        self.data.close()
        self.index.close()


def records_size(path: str) -> int:
    """Bytes of a record file, or of all of a folder's."""
    return sum(os.path.getsize(p) for p in _files(path, "*.rio"))


def clean_log(path: str, before: int) -> list[str]:
    """Deletes the log's segments of numbers below `before` - once what they hold is written elsewhere - oldest first,
    and returns their paths."""
    gone = [p for p in _files(path, "*.wal") if int(os.path.basename(p)[:-4]) < before]
    for p in gone:
        os.remove(p)
    return gone


class LogAppender:
    """A log of numbered segments.  A record that would take a segment beyond max_bytes starts the next one."""

    MOST = 1_000_000

    def __init__(self, path: str, max_bytes: int, compression: str = "none"):
        os.makedirs(path, exist_ok=True)
        # an existing log is continued in a segment of its own
        number = max((int(os.path.basename(p)[:-4]) for p in _files(path, "*.wal")), default=-1)
        self.path, self.max, self.code, self.number, self.file = path, max_bytes, codecs.CODES[compression], number, None
        self.rotate()

    def rotate(self) -> str | None:
        """Closes the segment and returns its path."""
        if self.number + 1 >= self.MOST:
            raise OverflowError("a log has a million segments at most")
        before = None
        if self.file:
            before = self.file.name
            self.file.close()
        self.number += 1
        self.file = open(os.path.join(self.path, f"{self.number:06d}.wal"), "xb")
        self.file.write(file_head(self.code))
        return before

    def append(self, record: bytes | None, sync: bool = False) -> None:
        if self.file.tell() + len(record or b"") > self.max:
            self.rotate()
        self.file.write(put_record(record, self.code))
        if sync:
            self.file.flush()
            os.fsync(self.file.fileno())

    def close(self) -> None:
        self.file.close()


def mutation(op: str, key: bytes, value: bytes = b"") -> bytes:
    """A log record of a PUT or DEL: a message with one of two parts, keys and values as bytes."""
    if op == "PUT":
        return put_field(1, put_field(3, key) + put_field(4, value))
    return put_field(2, put_field(2, key))


def parse_mutation(record: bytes) -> tuple[str, bytes, bytes | None]:
    """(op, key, value); older records hold text fields instead of bytes."""
    for number, body in fields(record):
        parts = dict(fields(body))
        if number == 1:
            return "PUT", parts.get(3) or parts.get(1, b""), parts.get(4) or parts.get(2, b"")
        if number == 2:
            return "DEL", parts.get(2) or parts.get(1, b""), None
    raise ValueError("a log record is neither a put nor a delete")


def encode_mutations(rows):
    """Rows (segment, key, value: null deletes), in order, as rows (segment, record) for the log source."""

    def encode(batches):
        for batch in _pieces(batches):
            segment, keys, values = batch.columns
            if keys.null_count:
                raise ValueError("a key is null")
            keys, gone = columns.plain(keys), values.is_null()
            records = columns.put_field(1, columns.join(columns.put_field(3, keys), columns.put_field(4, columns.plain(values))))
            if values.null_count:
                records = pc.if_else(gone, columns.put_field(2, columns.put_field(2, keys)), records)
            yield pa.RecordBatch.from_arrays([segment, records], names=["segment", "record"])

    return rows.select("segment", "key", "value").mapInArrow(encode, "segment int, record binary")


def mutation_columns(records: pa.BinaryArray) -> tuple[pa.Array, pa.BinaryArray, pa.BinaryArray]:
    """parse_mutation of each record, as columns (op, key, value)."""
    if not records.null_count:
        data, at, sizes = columns.flat(records)
        data, end = columns.padded(data), at + sizes
        put = data[at] == 10
        n, inner, good = columns.get_uvarints(data, at + 1)
        good &= (put | (data[at] == 18)) & (sizes > 0) & (n <= sizes) & (inner + n.astype(np.int64) == end) & (inner < end)
        inner = np.where(good, inner, 0)
        n, key, fine = columns.get_uvarints(data, inner + 1)
        good &= fine & (data[inner] == np.where(put, 26, 18)) & (n > 0) & (n <= sizes)
        n_key = np.where(good, n, 0).astype(np.int64)
        after = np.where(good, key + n_key, 0)
        more = after < end  # a put's value, unless it is empty
        good &= (after <= end) & (put | ~more)
        after = np.where(good, after, 0)
        n, value, fine = columns.get_uvarints(data, after + 1)
        good &= ~more | fine & (data[after] == 34) & (n > 0) & (n <= sizes) & (value + np.minimum(n, np.uint64(len(data))).astype(np.int64) == end)
        if good.all():
            n_value = np.where(more, n, 0).astype(np.int64)
            ops = pa.array(["PUT", "DEL"]).take(pa.array((~put).astype(np.int8)))
            return ops, columns.gather(data, key, n_key), columns.gather(data, value, n_value, ~put)
    ops, keys, values = zip(*(parse_mutation(r) for r in records.to_pylist())) if len(records) else ((), (), ())
    return pa.array(ops, pa.string()), pa.array(keys, pa.binary()), pa.array(values, pa.binary())


def decode_mutations(log):
    """Rows of the log source as MUTATION rows: seq orders by segment, then record."""

    def decode(batches):
        for batch in _pieces(batches):
            segment, ordinal, record = batch.columns
            seq = pc.add(pc.multiply(segment.cast(pa.int64()), 1 << 40), ordinal)
            yield pa.RecordBatch.from_arrays([seq, *mutation_columns(record.cast(pa.binary()))], names=["seq", "op", "key", "value"])

    return log.select("segment", "ordinal", "record").mapInArrow(decode, "seq long, op string, key binary, value binary")


def encode_messages(rows, message, json: str = "json"):
    """A column of JSON as rows (record) for the records source: each a protobuf message of that class; null stays nil."""

    def encode(batches):
        import pandas as pd
        from google.protobuf.json_format import Parse

        for pdf in batches:
            yield pd.DataFrame({"record": [None if x is None else Parse(x, message()).SerializeToString(deterministic=True) for x in pdf[json]]})

    return rows.select(json).mapInPandas(encode, "record binary")


def typed_messages(records, message, schema: str):
    """Rows of the records source as file, offset and the message's fields by a schema, e.g. `id long, name string`."""
    from pyspark.sql import functions as F

    return decode_messages(records, message).select("file", "offset", F.from_json("json", schema).alias("m")).select("file", "offset", "m.*")


def decode_messages(records, message):
    """Rows of the records source with the payload parsed by a protobuf message class, as JSON."""

    def decode(batches):
        from google.protobuf.json_format import MessageToJson

        for pdf in batches:
            yield pdf.assign(json=[None if r is None else MessageToJson(message.FromString(bytes(r)), indent=None) for r in pdf["record"]])[["file", "offset", "json"]]

    return records.mapInPandas(decode, "file string, offset long, json string")


def register(spark: SparkSession) -> None:
    for source in (RecordSource, LogSource, TableSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # offsets and key ranges
