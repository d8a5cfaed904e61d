import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.keys import fixed_key, int_key, signed_key
from tidemark.operators import history, lookup, memstore, tables, versions
from tidemark.plans.store import Store, StoreError


def kv(spark, rows, extra=""):
    return spark.createDataFrame(rows, "key int, value string" + extra)


KEYS = [79, 14, 91, 27, 62, 41, 58, 2, 20, 87, 34]


@pytest.mark.parametrize(("low", "high"), [(1, 100), (14, 14), (2, 91), (100, 200), (-5, 1), (15, 26), (3, 15), (90, 1000)])
def test_ranges(spark, low, high):
    df = kv(spark, [(k, str(k + 1)) for k in KEYS])
    assert [r.key for r in lookup.scan_range(df, low, high).collect()] == sorted(k for k in KEYS if low <= k <= high)
    assert [r.key for r in lookup.scan_from(df, low).collect()] == sorted(k for k in KEYS if k >= low)


def test_reversed_range(spark):
    with pytest.raises(ValueError):
        lookup.scan_range(kv(spark, []), 2, 1)
    holes = kv(spark, [(k, "") for k in (0, 1, 2, 4, 8, 9, 10)])
    assert [r.key for r in lookup.scan_range(holes, 3, 7).collect()] == [4]


def test_bytes_order(spark):
    keys = [b"", b"\x01", b"\x01\x00", b"\x7f", b"\x80", b"\xff"]
    df = spark.createDataFrame([(bytearray(k),) for k in reversed(keys)], "key binary")
    assert [bytes(r.key) for r in lookup.scan(df).collect()] == keys
    n = spark.createDataFrame([(x,) for x in (5, -1, 0, 2**40, -(2**63))], "n long")
    assert [r.n for r in n.orderBy(signed_key(F.col("n"))).collect()] == [-(2**63), -1, 0, 5, 2**40]
    assert n.where("n >= 0").select(int_key(F.col("n")).alias("k")).orderBy("k").collect()[1].k == bytearray((5).to_bytes(8, "big"))
    assert df.where("length(key) <= 1").select(fixed_key(F.col("key"), 2).alias("k")).distinct().count() == 5
    with pytest.raises(Exception, match="more than 1 bytes"):
        df.select(fixed_key(F.col("key"), 1)).collect()


def test_latest_and_reducers(spark):
    df = kv(spark, [(1, "a", 0), (1, None, 1), (2, "b", 0), (2, "", 3), (3, None, 0), (3, "c", 1)], ", gen long")
    assert {(r.key, r.value) for r in versions.live(df).collect()} == {(2, ""), (3, "c")}
    assert {(r.key, r.value) for r in versions.live(df, drop_empty=True).collect()} == {(3, "c")}
    assert {(r.key, r.value) for r in versions.merge_compact(df, versions.first_wins()).collect()} == {(1, "a"), (2, "b")}
    py = versions.merge_compact_python(df, lambda k, v, g: (k + 10, v[-1]) if v[-1] is not None else (None, None), "key int, value string")
    assert {(r.key, r.value) for r in py.collect()} == {(12, ""), (13, "c")}
    with pytest.raises(Exception, match="more than one table"):
        versions.merge_disjoint([df.select("key", "value").where("gen = 0"), df.select("key", "value").where("gen = 1")]).collect()
    got = lookup.get_many(df, spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "key int")).collect()
    assert {r.key: (r.status, r.value) for r in got} == {1: ("TOMBSTONED", None), 2: ("FOUND", ""), 3: ("FOUND", "c"), 4: ("NOT_FOUND", None)}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(memstore.OPS), st.integers(0, 4), st.sampled_from(["x", "yy", None])), max_size=60))
def test_map_against_dict(spark, ops):
    state, want = {}, []
    for op, k, v in ops:
        error = effect = None
        if op in ("ADD", "UPSERT"):
            if v is None:
                error = "VALUE_NULL"
            elif op == "ADD" and state.get(k) is not None:
                error = "KEY_EXISTS"
            else:
                state[k], effect = v, "PUT"
        elif op == "TOMBSTONE" or k in state:
            state[k], effect = None, "DEL"
        elif op == "DELETE":
            error = "KEY_NOT_FOUND"
        want.append((error, effect))
    log = spark.createDataFrame([(i, o, k, v) for i, (o, k, v) in enumerate(ops)], "seq long, op string, key int, value string")
    assert [(r.error, r.effect) for r in memstore.judged(log).orderBy("seq").collect()] == want
    assert {r.key: r.value for r in memstore.state(log).collect()} == state


@pytest.mark.parametrize(("total", "want"), [(70, 80), (120, 138), (20, 23), (220, 253)])
def test_estimate(spark, total, want):
    assert spark.range(1).select(memstore.estimate(F.lit(total)).alias("e")).first().e == want


def test_compaction_choice(spark):
    meta = spark.createDataFrame([(0, 10, 0, 500), (1, 10, 2, 500), (2, 10, 1, 500), (3, 0, 0, 10), (4, 10, 0, 500)], "gen long, num_records long, null_values long, total_bytes long")
    picked = tables.flood_fill(tables.candidates(meta, 100, 0.2)).orderBy("gen").collect()
    assert [r.selected for r in picked] == [False, True, False, True, False]
    assert [r.filled for r in picked] == [False, True, True, True, False]
    assert not any(r.filled for r in tables.flood_fill(tables.candidates(meta, 0, 1.0)).collect())
    with pytest.raises(ValueError):
        tables.candidates(meta, 1, 1.5)


def test_histories(spark):
    schema = "client int, op string, key string, val string, err string, call_ns long, return_ns long"
    rows = [
        (1, "put", "a", "1", None, 0, 10), (2, "get", "a", "1", None, 5, 6), (1, "get", "a", None, "missing", 1, 20),
        (1, "put", "b", "1", None, 0, 1), (1, "put", "b", "2", None, 2, 3), (2, "get", "b", "1", None, 4, 5),
    ]
    h = spark.createDataFrame(rows, schema)
    assert {r.key: r.ok for r in history.linearizable(h).collect()} == {"a": True, "b": False}
    assert not history.sequential(h.where("key = 'b'")).first().ok


def test_store(spark, tmp_path):
    schema = "seq long, op string, key binary, value binary"

    def batch(*rows):
        return spark.createDataFrame([(i, o, bytearray(k), None if v is None else bytearray(v)) for i, (o, k, v) in enumerate(rows)], schema)

    def content(s):
        return {bytes(r.key): bytes(r.value) for r in s.scan().collect()}

    path = str(tmp_path / "s")
    with pytest.raises(StoreError):
        Store(spark, path).scan()
    s = Store(spark, path, max_table_bytes=1 << 20, threshold=2).open()
    with pytest.raises(StoreError):
        s.open()
    with pytest.raises(StoreError):
        Store(spark, path).open()
    assert s.flush(batch(("PUT", b"a", b"1"), ("PUT", b"b", b"1"), ("PUT", b"a", b"2")), 0)
    assert not s.flush(batch(("PUT", b"a", b"9")), 0)
    s.flush(batch(("DEL", b"b", None), ("PUT", b"c", b"3")), 1)
    assert content(s) == {b"a": b"2", b"c": b"3"}
    assert {bytes(r.key): bytes(r.value) for r in s.scan_range(b"b", b"c").collect()} == {b"c": b"3"}
    with pytest.raises(Exception, match="unknown op"):
        s.flush(batch(("PUT", b"z", None)))
    assert s.compact() == []
    s.put(b"d", b"4")
    s.delete(b"a")
    with pytest.raises(ValueError):
        s.put(b"", b"1")
    before = content(s)
    assert content(s) == {b"c": b"3", b"d": b"4"}
    assert s.flush_memory() and not s.flush_memory()
    s.put(b"e", b"5")
    s.delete(b"e")
    assert s.compact() == [0, 1, 2, 3] and content(s) == before == {b"c": b"3", b"d": b"4"}
    assert [r.gen for r in s.meta().collect()] == [0] and s.meta().first().null_values == 0
    s.close()
    (tmp_path / "s" / "gen_000000000000099_x").mkdir()
    again = Store(spark, path).open()
    assert content(again) == before and not (tmp_path / "s" / "gen_000000000000099_x").exists()
    keys = spark.createDataFrame([(bytearray(k),) for k in (b"a", b"c")], "key binary")
    assert {bytes(r.key): r.status for r in again.get_many(keys).collect()} == {b"a": "NOT_FOUND", b"c": "FOUND"}


def test_partial_compaction_keeps_tombstones(spark):
    df = kv(spark, [(1, "a", 0), (1, None, 1), (2, "b", 2)], ", gen long")
    chosen = df.select("gen").distinct().withColumn("filled", F.col("gen") > 0)
    assert {r.key for r in versions.live(tables.compact(df, chosen, 1)).collect()} == {2}
    assert {r.key for r in versions.live(tables.compact(df, chosen, 1, keep_tombstones=False)).collect()} == {1, 2}


def test_stream(spark, tmp_path):
    from tidemark.streaming.flows import flush_stream, latest_stream

    schema = "seq long, op string, key string, value string"
    source, path = tmp_path / "in", str(tmp_path / "s")
    source.mkdir()
    store = Store(spark, path).open()

    def drain():
        raw = spark.readStream.schema(schema).json(str(source))
        bytes_ = raw.select("seq", "op", F.encode("key", "UTF-8").alias("key"), F.encode("value", "UTF-8").alias("value"))
        flush_stream(bytes_, store, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        q = latest_stream(raw).writeStream.outputMode("complete").format("memory").queryName("latest_view").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
        q.awaitTermination()
        return {r.key: r.value for r in spark.table("latest_view").collect()}

    (source / "1.json").write_text('{"seq":1,"op":"PUT","key":"a","value":"1"}\n{"seq":3,"op":"PUT","key":"b","value":"3"}\n')
    drain()
    (source / "2.json").write_text('{"seq":4,"op":"DEL","key":"a"}\n{"seq":2,"op":"PUT","key":"b","value":"late"}\n')
    assert drain() == {"a": None, "b": "3"}
    assert len(store.meta().collect()) == 2
    drain()  # nothing new: nothing is written twice
    assert len(store.meta().collect()) == 2
    assert list(itertools.chain(*[[bytes(r.key)] for r in store.scan().collect()])) == [b"b"]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_sequenced_rows_with_payload(spark, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 120_000
        df = spark.range(n).select(F.floor(F.col("id") / 50_000).alias("segment"), F.col("id").alias("event_id"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 10).alias("payload"))
        df = df.repartition(7, F.xxhash64("event_id"))
        r = versions.sequenced(df, "segment", "event_id").agg(F.count("*"), F.count_if(F.col("seq") != F.col("event_id") + 1), F.count_distinct("seq")).first()
        assert tuple(r) == (n, 0, n)
        ties = spark.createDataFrame([(None, 1), (2, 1), (2, 1), (1, None), (2, 0)], "a int, b int")
        got = sorted((r.seq, r.a, r.b) for r in versions.sequenced(ties, "a", "b", bins=2).collect())
        assert got == [(1, None, 1), (2, 1, None), (3, 2, 0), (4, 2, 1), (5, 2, 1)]
        assert versions.sequenced(ties.where("a > 5"), "a", "b").collect() == []
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_store_after_a_crash(spark, tmp_path):
    path = str(tmp_path / "s")
    code = f"""
import os
from tidemark.plans.store import Store
from tidemark.sources import records
s = Store(None, {path!r}).open()
for i in range(50):
    s.put(b"k%02d" % (i % 20), b"v%d" % i)
s.delete(b"k03")
s.log.file.write(records.put_record(records.mutation("PUT", b"k03", b"torn"), 0)[:-2])
s.log.file.flush()
os._exit(1)
"""
    import subprocess
    import sys

    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 1
    s = Store(spark, path).open()  # the owner is dead
    want = {b"k%02d" % (i % 20): b"v%d" % i for i in range(50) if i % 20 != 3}
    rows = lambda df: {bytes(r.key): bytes(r.value) for r in df.collect()}
    assert rows(s.scan()) == want
    assert rows(s.scan_range(b"k05", b"k06")) == {k: want[k] for k in (b"k05", b"k06")}
    s.put(b"k03", b"again")
    s.close()
    s = Store(spark, path).open()
    assert rows(s.scan()) == want | {b"k03": b"again"} and len(s.manifest["tables"]) == 1
    # a writer that lost its lease can't publish
    with pytest.raises(StoreError):
        Store(spark, path).open()
    late = Store(spark, path, lease=-1).open()
    s.put(b"z", b"1")
    with pytest.raises(StoreError, match="took the lease over"):
        s.flush_memory()
    late.close()


def test_readers_keep_their_snapshot(spark, tmp_path):
    path = str(tmp_path / "s")
    s = Store(spark, path, threshold=1, memstore_bytes=25).open()
    for i in range(10):
        s.put(b"key%d" % i, b"value")  # some fill the memory and become a generation
    assert len(s.manifest["tables"]) > 1
    s.flush_memory()
    before = s.scan()
    assert s.compact() and before.count() == 10 == s.scan().count()
    assert s.vacuum() == []
    s.retention = -1
    assert len(s.vacuum()) > 2 and s.scan().count() == 10
    for batch in (0, 2, 1):
        assert s.flush(spark.createDataFrame([(0, "PUT", bytearray(b"b%d" % batch), bytearray(b"v"))], "seq long, op string, key binary, value binary"), batch)
    assert not s.flush(before.limit(0), 0) and s.manifest["upto"] == 2 and s.manifest["batches"] == []
    s.close()
