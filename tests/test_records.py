import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codecs
from tidemark.sources import records as R


def rio(values, code=0):
    return R.file_head(code) + b"".join(R.put_record(v, code) for v in values)


def test_golden():
    assert codecs.put_uvarint(R.MAGIC) == bytes.fromhex("918d4c")
    assert f"{codecs.crc64_iso(bytes([0, 0, 0, 5])):016x}" == "688fffff90000000"
    assert f"{codecs.crc64_iso(bytes([0, 0, 0, 0x15])):016x}" == "738fffff90000000"
    assert codecs.crc32c(b"123456789") == 0xE3069283
    assert len(rio([bytes(range(5))])) == 0x18
    assert len(rio([bytes([i]) for i in range(127)])) == 0x5FC
    assert [o for o, _ in R.read_records(rio([None, b""]))] == [8, 0x13]


@pytest.mark.parametrize("code", [0, 1, 2, 3])
def test_roundtrip(code):
    values = [bytes(range(n)) for n in range(255)] + [None, b"", bytes(70000)]
    data = rio(values, code)
    assert [r for _, r in R.read_records(data)] == values
    assert [r for _, r in R.read_records(data, skip=250)] == values[250:]
    offsets = [o for o, _ in R.read_records(data)]
    for at, want in zip(offsets, values):
        assert R.read_at(data, at, 4, code)[0] == want


def test_magic_in_payload_is_no_record():
    mark = bytes.fromhex("918d4c")
    data = rio([mark, bytes([21, 8, 23]), mark])
    offsets = [o for o, _ in R.read_records(data)]
    assert len(offsets) == 3
    found, at = [], 0
    while (hit := R.seek(data, at)) is not None:
        found.append(hit[0])
        at = hit[0] + 1
    assert found == offsets


def test_errors():
    good = rio([bytes(range(13))])
    for head, kind in ((struct.pack("<II", 0, 0), "VERSION"), (struct.pack("<II", 256, 0), "VERSION"), (struct.pack("<II", 4, 300), "COMPRESSION")):
        with pytest.raises(R.RecordError, match=kind):
            list(R.read_records(head + good[8:]))
    with pytest.raises(R.RecordError, match="MAGIC"):
        list(R.read_records(good[:8] + b"\x92" + good[9:]))
    with pytest.raises(R.RecordError, match="CHECKSUM"):
        list(R.read_records(good[:14] + bytes([good[14] ^ 1]) + good[15:]))
    assert len(list(R.read_records(good + bytes(1000)))) == 1
    with pytest.raises(R.RecordError, match="MAGIC"):
        list(R.read_records(good + bytes(1000) + b"x"))
    with pytest.raises(R.RecordError, match="TORN"):
        list(R.read_records(good[:-2]))
    assert list(R.read_records(good[:-2], tolerate_torn_tail=True)) == []


def test_older_versions():
    one = struct.pack("<II", 1, 0) + struct.pack("<IQQ", R.MAGIC, 3, 0) + b"abc"
    two = struct.pack("<II", 2, 0) + codecs.put_uvarint(R.MAGIC) + b"\x03\x00abc"
    three = struct.pack("<II", 3, 0) + codecs.put_uvarint(R.MAGIC) + b"\x00\x03\x00abc" + codecs.put_uvarint(R.MAGIC) + b"\x01\x00\x00"
    assert [r for _, r in R.read_records(one)] == [b"abc"]
    assert [r for _, r in R.read_records(two)] == [b"abc"]
    assert [r for _, r in R.read_records(three)] == [b"abc", None]
    with pytest.raises(ValueError):
        R.seek(one, 0)


def test_sources(spark, tmp_path):
    R.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.range(0, 500, 1, 3).selectExpr("if(id % 50 = 0, null, cast(cast(id as string) as binary)) as record")
    rows.write.format("records").option("path", str(tmp_path / "r")).option("compression", "snappy").mode("append").save()
    back = spark.read.format("records").option("splitBytes", 500).load(str(tmp_path / "r"))
    assert back.rdd.getNumPartitions() > 3
    assert sorted(r.record or b"" for r in back.collect()) == sorted(r.record or b"" for r in rows.collect())
    assert back.where("offset = 8").count() == 3

    log = R.LogAppender(str(tmp_path / "log"), 60)
    for i in range(20):
        log.append(R.mutation("DEL" if i % 5 == 4 else "PUT", b"k%d" % (i % 7), b"v%d" % i), sync=i == 3)
    log.close()
    replay = R.decode_mutations(spark.read.format("log").load(str(tmp_path / "log"))).orderBy("seq").collect()
    assert [(r.op, bytes(r.key)) for r in replay] == [("DEL" if i % 5 == 4 else "PUT", b"k%d" % (i % 7)) for i in range(20)]

    R.write_table(str(tmp_path / "t" / "a"), [(struct.pack(">I", i), struct.pack(">I", i + 1)) for i in range(1, 8)])
    meta = R.write_table(str(tmp_path / "t" / "b"), [(b"akey", None), (b"bkey", b"")])
    assert (meta["num_records"], meta["null_values"]) == (2, 1) and b"akey" in meta["bloom"]
    table = spark.read.format("sortedtable").load(str(tmp_path / "t"))
    assert [(r.gen, bytes(r.key), r.value) for r in table.where("gen = 1").orderBy("key").collect()] == [(1, b"akey", None), (1, b"bkey", b"")]
    assert table.where("gen = 0 and key >= X'00000003' and key <= X'00000005'").count() == 3
    with open(tmp_path / "t" / "a" / "data.rio", "r+b") as file:
        data = file.read()
        offsets = [o for o, _ in R.read_records(data)]
        file.seek(offsets[4] - 1)
        file.write(b"\x15")
    with pytest.raises(Exception, match="isn't the one written"):
        spark.read.format("sortedtable").load(str(tmp_path / "t" / "a")).collect()
    assert spark.read.format("sortedtable").option("checkValues", "false").load(str(tmp_path / "t" / "a")).count() == 7
    for bad in ([(b"b", b""), (b"a", b"")], [(b"a", b""), (b"a", b"")]):
        with pytest.raises(ValueError):
            R.write_table(str(tmp_path / f"bad{bad[1][0] == bad[0][0]}"), bad)


def test_bloom_and_lzw():
    bloom = codecs.Bloom(500, 0.01)
    for i in range(500):
        bloom.add(b"%d" % i)
    assert all(b"%d" % i in bloom for i in range(500))
    assert sum(b"x%d" % i in bloom for i in range(5000)) < 200
    with pytest.raises(ValueError):
        codecs.Bloom(0)
    for n in (0, 1, 257, 5000, 100000):
        x = bytes(i * i % 251 for i in range(n))
        assert codecs.lzw_decompress(codecs.lzw_compress(x)) == x


def test_checksums_byte_by_byte():
    import os

    for crc in (codecs.crc32c, codecs.crc64_iso):

        def slow(data):
            c = crc.ones
            for b in data:
                c = c >> 8 ^ crc.table[(c ^ b) & 255]
            return c ^ crc.ones

        values = [os.urandom(n) for n in (0, 1, 3, 7, 8, 47, 48, 1023, 1024, 1025, 1031, 2050)] + [os.urandom(1027) for _ in range(70)] + [os.urandom(2) for _ in range(70)]
        assert [crc(v) for v in values] == [slow(v) for v in values] == crc.column(values)
        assert crc.column([None, b"a"]) == [None, slow(b"a")]


def test_tables_side_by_side(spark, tmp_path):
    R.register(spark)
    path = str(tmp_path / "tables")
    rows = spark.range(60_000).selectExpr("id % 3 as gen", "cast(lpad(cast(id as string), 9, '0') as binary) as key", "if(id % 100 = 7, null, cast(repeat('v', 20) as binary)) as value")
    R.save_tables(rows, path, "none")
    table = spark.read.format("sortedtable").load(path)
    assert table.count() == 60_000 and table.where("value is null").count() == 600
    one = f"{41_234:09d}".encode()
    assert [(r.gen, bytes(r.key)) for r in table.where(f"key = X'{one.hex()}'").collect()] == [(41_234 % 3, one)]
    assert table.where(f"key >= X'{one.hex()}' and key <= X'{b'000041999'.hex()}'").count() == 41_999 - 41_234 + 1
    with open(f"{path}/gen_{1:015d}/bloom.bin", "rb") as file:
        bloom = codecs.Bloom.load(file.read())
    assert all(f"{i:09d}".encode() in bloom for i in range(1, 60_000, 3)) and sum(f"{i:09d}".encode() in bloom for i in range(0, 60_000, 3)) < 1000
    # a table that exists isn't written again, and a repeated key is refused
    for bad in (rows.limit(3), rows.limit(2).union(rows.limit(2)).withColumn("gen", F.lit(9).cast("long"))):
        with pytest.raises(Exception):  # noqa: B017
            R.save_tables(bad, path)
    assert spark.read.format("sortedtable").load(path).count() == 60_000


def test_log_segments_size_and_cleaner(spark, tmp_path):
    R.register(spark)
    path = str(tmp_path / "log")
    rows = spark.range(1000).selectExpr("cast(id div 100 as int) as segment", "cast(id as string) as k").selectExpr("segment", "cast(k as binary) as key", "if(k like '%3', null, cast(k as binary)) as value").repartition("segment").sortWithinPartitions("segment", "key")
    R.encode_mutations(rows).write.format("log").mode("append").save(path)
    back = R.decode_mutations(spark.read.format("log").load(path))
    assert back.count() == 1000 and back.where("op = 'DEL'").count() == 100
    assert len(R.clean_log(path, 4)) == 4
    assert R.decode_mutations(spark.read.format("log").load(path)).count() == 600
    more = R.LogAppender(path, 1 << 20)
    more.append(R.mutation("PUT", b"k", b"v"))
    more.close()
    assert (tmp_path / "log" / "000010.wal").exists()
    spark.range(10).selectExpr("cast(cast(id as string) as binary) as record").coalesce(1).write.format("records").mode("append").save(str(tmp_path / "r"))
    assert R.records_size(str(tmp_path / "r")) == 8 + 10 * len(R.put_record(b"1", 0))


def test_messages(spark, tmp_path):
    wrappers = pytest.importorskip("google.protobuf.struct_pb2")
    R.register(spark)
    docs = spark.createDataFrame([('{"a":1,"b":"x"}',), ('{"b":"y"}',), (None,)], "json string")
    R.encode_messages(docs, wrappers.Struct).write.format("records").mode("append").save(str(tmp_path / "m"))
    got = R.typed_messages(spark.read.format("records").load(str(tmp_path / "m")), wrappers.Struct, "a double, b string").collect()
    assert {(r.a, r.b) for r in got} == {(1.0, "x"), (None, "y"), (None, None)} and len(got) == 3


def test_columns_of_records_are_those_of_single_ones():
    import os

    import pyarrow as pa

    from tidemark.functions import columns

    mark = codecs.put_uvarint(R.MAGIC)
    values = [None, b"", b"a" * 14, b"a" * 15, b"a" * 61, os.urandom(300), os.urandom(70_000), mark, R.put_record(b"abc", 0) * 3] + [b"%d" % i for i in range(2000)] + [None]
    for code in (0, 1, 2, 3):
        data = R.file_head(code) + b"".join(R.put_record(v, code) for v in values)
        assert R.file_head(code) + bytes(columns.content(R.put_records(pa.array(values, pa.binary()), code))) == data
        both = lambda d, **o: (list(R.read_records(d, **o)), [(int(at), v) for ats, vs in R.record_columns(d, **o) for at, v in zip(ats, vs.to_pylist())])
        for d in (data, data + bytes(1000)):
            slow, fast = both(d)
            assert slow == fast and [v for _, v in fast] == values
        offsets = [at for at, _ in slow]
        slow, fast = both(data, at=offsets[5], end=offsets[900] + 1)
        assert slow == fast and len(fast) == 896
        slow, fast = both(data + R.put_record(b"torn", code)[:-1], tolerate_torn_tail=True)
        assert slow == fast and len(fast) == len(values)
        with pytest.raises(R.RecordError, match="CHECKSUM"):
            list(R.record_columns(data[: offsets[900] + 6] + bytes([data[offsets[900] + 6] ^ 1]) + data[offsets[900] + 7 :]))
    ops = [R.mutation("PUT", b"k", b""), R.mutation("PUT", b"k" * 300, b"v" * 20_000), R.mutation("DEL", b"d")]
    older = [R.put_field(1, R.put_field(1, b"old") + R.put_field(2, b"v")), R.mutation("PUT", b"", b"v")]
    for some in (ops, ops + older):
        assert list(zip(*(c.to_pylist() for c in R.mutation_columns(pa.array(some, pa.binary()))))) == [R.parse_mutation(m) for m in some]


def test_small_segments_share_tasks(spark, tmp_path):
    R.register(spark)
    path = str(tmp_path / "log")
    rows = spark.range(3000).selectExpr("cast(id div 10 as int) as segment", "id", "cast(cast(id as string) as binary) as key", "if(id % 7 = 0, null, cast(repeat('v', cast(id % 40 as int)) as binary)) as value").repartition("segment").sortWithinPartitions("segment", "id")
    R.encode_mutations(rows).write.format("log").mode("append").save(path)
    log = spark.read.format("log").load(path)
    assert log.rdd.getNumPartitions() < 30  # of 300 segments
    got = [(r.seq, r.op, bytes(r.key), r.value if r.value is None else bytes(r.value)) for r in R.decode_mutations(log).orderBy("seq").collect()]
    assert got == [(i // 10 * (1 << 40) + i % 10, "PUT" if i % 7 else "DEL", b"%d" % i, b"v" * (i % 40) if i % 7 else None) for i in range(3000)]


def test_small_tables_share_tasks(spark, tmp_path):
    R.register(spark)
    path = str(tmp_path / "tables")
    rows = spark.range(6000).selectExpr("id % 300 as gen", "cast(lpad(cast(id as string), 9, '0') as binary) as key", "if(id % 7 = 0, null, cast(repeat('v', cast(id % 40 as int)) as binary)) as value")
    R.save_tables(rows, path)
    table = spark.read.format("sortedtable").load(path)
    assert table.rdd.getNumPartitions() < 30  # of 300 tables
    got = [(r.gen, bytes(r.key), r.value if r.value is None else bytes(r.value)) for r in table.orderBy("key").collect()]
    assert got == [(i % 300, b"%09d" % i, b"v" * (i % 40) if i % 7 else None) for i in range(6000)]
    assert table.where(f"key >= X'{b'000000100'.hex()}' and key <= X'{b'000001099'.hex()}'").count() == 1000


def test_values_of_tables_in_any_order_and_of_older_ones(tmp_path):
    import numpy as np

    data = rio([b"v%d" % i * (i % 90) if i % 9 else None for i in range(3000)], 2)
    rows = list(R.read_records(data))
    for order in (range(3000), range(2999, -1, -1), [i * 7 % 3000 for i in range(3000)], [5], []):
        assert R.values_at(data, np.array([rows[i][0] for i in order], np.int64), 4, 2).to_pylist() == [rows[i][1] for i in order]
    # values beyond a window, keys of no bytes, and a table without checksums
    R.write_table(str(tmp_path / "t"), [(b"", b"x" * (5 << 20)), (b"a", None), (b"b", b""), (b"c", b"y" * (5 << 20)), (b"d", b"z")], "none")
    read = lambda: [(k, v) for b in R._TableReader({"path": str(tmp_path / "t")}).read(R._Group([(str(tmp_path / "t"), 0)])) for k, v in zip(b.column("key").to_pylist(), b.column("value").to_pylist())]
    want = [(b"", b"x" * (5 << 20)), (b"a", None), (b"b", b""), (b"c", b"y" * (5 << 20)), (b"d", b"z")]
    assert read() == want
    with open(tmp_path / "t" / "index.rio", "rb") as file:
        entries = [dict(R.fields(e)) for _, e in R.read_records(file.read())]
    with open(tmp_path / "t" / "index.rio", "wb") as file:
        file.write(rio([R.put_field(1, e.get(1, b"")) + R.put_field(2, e[2]) for e in entries]))
    assert read() == want


def test_one_key_of_many_small_tables(spark, tmp_path):
    R.register(spark)
    path = str(tmp_path / "tables")
    rows = spark.range(3000).selectExpr("id % 300 as gen", "cast(lpad(cast(id div 600 as string), 9, '0') as binary) as key", "cast(cast(id % 600 as string) as binary) as value").where("gen % 3 = 0").dropDuplicates(["gen", "key"])
    R.save_tables(rows, path)
    one = spark.read.format("sortedtable").load(path).where(f"key = X'{b'000000004'.hex()}'")
    assert one.rdd.getNumPartitions() < 10  # of 100 tables
    assert sorted((r.gen, bytes(r.key)) for r in one.collect()) == [(g, b"000000004") for g in range(100)]
    # a filter is asked bit by bit; where it says no the table isn't opened, where it is missing the table is searched
    bloom = codecs.Bloom(400)
    for i in range(400):
        bloom.add(b"%d" % i)
    assert [codecs.Bloom.asked(bloom.dump(), codecs.fnv1_64(b"%d" % i)) for i in range(3000)] == [b"%d" % i in bloom for i in range(3000)]
    (tmp_path / "tables" / f"gen_{0:015d}" / "index.rio").write_bytes(b"not a table")
    (tmp_path / "tables" / f"gen_{3:015d}" / "bloom.bin").unlink()
    assert spark.read.format("sortedtable").load(path).where(f"key = X'{b'no such key'.hex()}'").count() == 0
