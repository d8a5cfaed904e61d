"""The queries of the key-value operators over the driver's tables, with the same results in SQL.

events is the log: seq = event_id, key = user_id as ten digits, value = props, an `error` is a tombstone, and gen
is a block of consecutive events.  orders stands for a table with unique keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import history, lookup, memstore, tables, versions


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(spark: SparkSession, d: str, block: int = 1000) -> DataFrame:
    e = _read(spark, d, "events")
    value = F.when(F.col("event_type") != "error", F.col("props"))
    return e.select(F.col("event_id").alias("seq"), F.lpad(F.col("user_id").cast("string"), 10, "0").alias("key"), value.alias("value"), F.floor(F.col("event_id") / block).cast("long").alias("gen"))


def _tables(spark: SparkSession, d: str, block: int = 1000) -> DataFrame:
    """One row per key and generation: the latest of each."""
    log = _log(spark, d, block)
    return log.groupBy("key", "gen").agg(F.max_by(F.struct("value"), "seq").alias("r")).select("key", F.col("r.value").alias("value"), "gen")


def _layers(spark: SparkSession, d: str, block: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables, read store and write store: the newest generation is the write store, the one before the read store."""
    t, gens = _tables(spark, d, block), _log(spark, d, block).where("gen is not null").select("gen").distinct()
    newest = [r.gen for r in gens.orderBy(F.desc("gen")).limit(2).collect()]
    return t.where(~F.col("gen").isin(newest)), t.where(F.col("gen").isin(newest[1:])), t.where(F.col("gen").isin(newest[:1]))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    o = _read(spark, d, "orders")
    return o.select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("key"), F.col("o_orderpriority").alias("value"))


def _probes(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("key"))


def _ops(spark: SparkSession, d: str) -> DataFrame:
    """The log as operations of a sorted map."""
    op = F.when(F.col("event_id") % 5 == 0, "ADD").when(F.col("event_id") % 5 == 1, "DELETE").when(F.col("event_id") % 5 == 2, "DELETE_IF_EXISTS").when(F.col("event_type") == "error", "TOMBSTONE").otherwise("UPSERT")
    return _read(spark, d, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.lpad(F.col("user_id").cast("string"), 10, "0").alias("key"), F.col("props").alias("value"))


M = "m as (select event_id as seq, lpad(cast(user_id as varchar), 10, '0') as \"key\", case when event_type <> 'error' then props end as value, cast(event_id // {block} as bigint) as gen from events)"
T_ = M + ', t as (select "key", value, gen from (select *, row_number() over (partition by "key", gen order by seq desc) as rn from m) where rn = 1)'
LATEST = ', r as (select *, row_number() over (partition by "key" order by gen desc) as rn from t), l as (select "key", value, gen from r where rn = 1)'
O = "o as (select lpad(cast(o_orderkey as varchar), 10, '0') as \"key\", o_orderpriority as value from orders)"
P = "p as (select lpad(cast(c_custkey as varchar), 10, '0') as \"key\" from customer)"
META = ', meta as (select gen, count(*) as num_records, count(*) - count(value) as null_values, min("key") as min_key, max("key") as max_key, cast(sum(coalesce(strlen(value), 0)) as bigint) as data_bytes, cast(sum(strlen("key")) as bigint) as index_bytes, cast(sum(coalesce(strlen(value), 0) + strlen("key")) as bigint) as total_bytes from t group by gen)'
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _with(*parts: str, select: str, block: int = 1000) -> str:
    return "with " + "".join(parts).replace("{block}", str(block)) + " " + select


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(_with(M, ', r as (select *, row_number() over (partition by "key" order by seq desc) as rn from m)', select='select "key", value, gen from r where rn = 1 and value is not null'))
def kv_latest(spark, d):
    return versions.live(_log(spark, d), "seq").select("key", "value", "gen")


@query(_with(M, ', r as (select *, row_number() over (partition by "key" order by seq desc) as rn from m)', select='select "key", value, gen from r where rn = 1'))
def kv_latest_tombstones(spark, d):
    return versions.keep_latest(_log(spark, d), "seq").select("key", "value", "gen")


@query(_with(T_, LATEST, select='select "key" from l where value is null'))
def kv_tombstoned(spark, d):
    return versions.keep_latest(_tables(spark, d)).where("value is null").select("key")


@query(_with(T_, LATEST, select="select \"key\", case when value is null then 'TOMBSTONED' else 'FOUND' end as status, value from l"))
def kv_live_flags(spark, d):
    return lookup.with_status(versions.keep_latest(_tables(spark, d)))


@query(_with(T_, LATEST, ", ", P, select="select p.\"key\", case when l.\"key\" is null then 'NOT_FOUND' when value is null then 'TOMBSTONED' else 'FOUND' end as status, value from p left join l using (\"key\")"))
def kv_multi_get(spark, d):
    return lookup.get_many(_tables(spark, d), _probes(spark, d))


@query(_with(T_, ", ", P, select='select "key" from p where "key" in (select "key" from t)'))
def kv_contains(spark, d):
    return lookup.contains_many(_tables(spark, d), _probes(spark, d))


@query(_with(T_, ", ", P, select='select "key" from p where "key" not in (select "key" from t)'))
def kv_missing(spark, d):
    return lookup.missing(_tables(spark, d), _probes(spark, d))


@query(_with(T_, LATEST, select="select \"key\", value from l where \"key\" = '0000000007'"))
def kv_point_get(spark, d):
    return versions.keep_latest(lookup.get(_tables(spark, d), "0000000007")).select("key", "value")


#: the generations from the newest (nth 1: the write store, nth 2: the read store, else tables)
_NTH = ', nth as (select gen, row_number() over (order by gen desc) as nth from (select distinct gen from t where gen is not null)), x as (select "key", value, nth from t join nth using (gen)), y as (select *, row_number() over (partition by "key" order by nth) as rn from x)'


@query(_with(T_, _NTH, ", ", P, select="select p.\"key\", case when y.\"key\" is null or length(value) = 0 then 'NOT_FOUND' when value is null then 'TOMBSTONED' else 'FOUND' end as status, value from p left join (select * from y where rn = 1) y using (\"key\")"))
def kv_layered_get(spark, d):
    return lookup.get_many(lookup.layered(*_layers(spark, d)), _probes(spark, d), empty_is_missing=True)


@query(_with(T_, _NTH, ", ", P, select='select p."key", coalesce(bool_or(value is not null), false) as "either", coalesce(bool_or(rn = 1 and value is not null), false) as live from p left join (select * from y where nth <= 2) y using ("key") group by p."key"'))
def rw_contains(spark, d):
    _, read, write = _layers(spark, d)
    return memstore.rw_contains(write, read, _probes(spark, d))


@query(_with(O, select="select * from o"))
def scan_full(spark, d):
    return lookup.scan(_orders(spark, d))


@query(_with(O, select="select * from o where \"key\" >= '0000010000'"))
def scan_from(spark, d):
    return lookup.scan_from(_orders(spark, d), "0000010000")


@query(_with(O, select="select * from o where \"key\" between '0000000500' and '0000000900'"))
def scan_range(spark, d):
    return lookup.scan_range(_orders(spark, d), "0000000500", "0000000900")


@query(_with(O, select="select * from o where \"key\" between '0000000500' and '0000000500'"))
def scan_range_single(spark, d):
    return lookup.scan_range(_orders(spark, d), "0000000500", "0000000500")


@query(_with(O, select="select * from o where \"key\" between 'x' and 'y'"))
def scan_range_outside(spark, d):
    return lookup.scan_range(_orders(spark, d), "x", "y")


@query("select doc_id, n_chars from documents")
def scan_keys(spark, d):
    """Small keys beside large values: the values are never read."""
    return lookup.scan(_read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")


@query(_with(T_, LATEST, select='select "key", value from l where value is not null'))
def super_scan(spark, d):
    return lookup.scan(versions.live(_tables(spark, d)).select("key", "value"))


@query(_with(T_, LATEST, select="select \"key\", value from l where value is not null and \"key\" between '0000000010' and '0000000050'"))
def super_scan_range(spark, d):
    return lookup.scan_range(versions.live(_tables(spark, d)).select("key", "value"), "0000000010", "0000000050")


@query(_with(O, select="select * from o"))
def merge_disjoint(spark, d):
    o = _orders(spark, d)
    last = F.substring("key", -1, 1)
    return versions.merge_disjoint([o.where(last < "3"), o.where((last >= "3") & (last < "7")), o.where(last >= "7")])


@query(_with(T_, select='select "key", value, gen from t'))
def merge_ordered_dups(spark, d):
    t = _tables(spark, d)
    halves = [t.where("gen % 2 = 0"), t.where("gen % 2 = 1")]
    return versions.merge_ordered([h.withColumn("made", F.col("gen")) for h in halves]).select("key", "value", F.col("made").alias("gen"))


@query(_with(T_, select='select "key", value from (select *, row_number() over (partition by "key" order by gen) as rn from t) where rn = 1 and value is not null'))
def compact_first(spark, d):
    return versions.merge_compact(_tables(spark, d), versions.first_wins())


@query(_with(T_, select='select "key", count(*) as value from t group by "key"'))
def compact_count(spark, d):
    return versions.merge_compact(_tables(spark, d), F.count("*"))


@query(_with(T_, select='select "key", string_agg(value, \'|\' order by gen) as value from t group by "key" having count(value) > 0'))
def compact_concat(spark, d):
    out = versions.merge_compact(_tables(spark, d), versions.joined_values("|"))
    return out.where(F.length("value") > 0)


@query(_with(T_, select='select "key", value from t where false'))
def compact_drop_all(spark, d):
    return versions.merge_compact(_tables(spark, d), F.max(F.lit(None).cast("string")))


@query(_with(T_, LATEST, select='select "key", value from l where length(value) > 0'))
def compact_full(spark, d):
    return versions.merge_compact(_tables(spark, d), versions.latest_wins(), empty_is_null=True)


_PART = ', q as (select *, row_number() over (partition by "key" order by gen desc) as rn from t where gen between 3 and 7)'


@query(_with(T_, _PART, select='select "key", value, gen from t where gen not between 3 and 7 union all select "key", value, 3 as gen from q where rn = 1'))
def compact_partial_safe(spark, d):
    t = _tables(spark, d)
    chosen = t.select("gen").distinct().withColumn("filled", F.col("gen").between(3, 7))
    return tables.compact(t, chosen, threshold=0)


@query(_with(T_, _PART, select='select "key", value, gen from t where gen not between 3 and 7 union all select "key", value, 3 as gen from q where rn = 1 and length(value) > 0'))
def compact_partial_legacy(spark, d):
    t = _tables(spark, d)
    chosen = t.select("gen").distinct().withColumn("filled", F.col("gen").between(3, 7))
    return tables.compact(t, chosen, threshold=0, keep_tombstones=False)


@query(_with(T_, META, select="select * from meta"))
def table_meta(spark, d):
    return tables.table_meta(_tables(spark, d))


@query(_with(T_, META, select="select cast(sum(num_records) as bigint) as num_records, max(min_key) as first_key, min(min_key) as min_key, max(max_key) as max_key, cast(sum(data_bytes) as bigint) as data_bytes, cast(sum(index_bytes) as bigint) as index_bytes, cast(sum(total_bytes) as bigint) as total_bytes from meta"))
def super_meta(spark, d):
    return tables.super_meta(tables.table_meta(_tables(spark, d)))


@query(_with(T_, select="select string_agg(path, ',' order by gen) as base_path from (select distinct gen, 'gen_' || lpad(cast(gen as varchar), 15, '0') as path from t)"))
def super_base_path(spark, d):
    t = _tables(spark, d).select("gen").distinct()
    return tables.base_path(t.withColumn("path", F.concat(F.lit("gen_"), F.lpad(F.col("gen").cast("string"), 15, "0"))))


@query(_with(T_, LATEST, select="select cast(floor(cast(1.15 as float) * cast(sum(strlen(\"key\") + coalesce(strlen(value), 0)) as float)) as bigint) as estimated_bytes from l"))
def memstore_estimate(spark, d):
    return memstore.estimated_size(versions.keep_latest(_tables(spark, d)))


@query(_with(T_, select='select count(distinct "key") as size from t'))
def memstore_size(spark, d):
    return memstore.size(_tables(spark, d))


_SMALL = META + ", c as (select *, cast(null_values as float) / cast(num_records as float) as tombstone_ratio, (total_bytes < {max}) or (cast(null_values as float) / cast(num_records as float)) >= cast(0.2 as float) as selected from meta)"


@query(_with(T_, META, select="select gen, null_values, num_records, cast(cast(null_values as float) / cast(num_records as float) as double) as tombstone_ratio from meta"))
def tombstone_ratio(spark, d):
    return tables.with_ratio(tables.table_meta(_tables(spark, d))).select("gen", "null_values", "num_records", F.col("tombstone_ratio").cast("double").alias("tombstone_ratio"))


@query(_with(T_, _SMALL.replace("{max}", "100"), select="select gen, total_bytes, selected from c"))
def compaction_candidates(spark, d):
    return tables.candidates(tables.table_meta(_tables(spark, d)), 100).select("gen", "total_bytes", "selected")


@query(_with(T_, _SMALL.replace("{max}", "100"), select="select gen, selected, coalesce(gen between (select min(gen) from c where selected) and (select max(gen) from c where selected), false) as filled from c"))
def flood_fill(spark, d):
    return tables.flood_fill(tables.candidates(tables.table_meta(_tables(spark, d)), 100)).select("gen", "selected", "filled")


@query(_with(M, select="select seq, cast(8 + coalesce(sum(strlen(coalesce(value, ''))) over (order by seq rows between unbounded preceding and 1 preceding), 0) as bigint) as payload_offset from m"))
def record_offsets(spark, d):
    """Where each payload of one file would start, headers aside: offsets within segments of the log, shifted by the
    segments before, so that no task holds more than one segment."""
    m = _log(spark, d).select("seq", "gen", F.octet_length(F.coalesce("value", F.lit(""))).alias("n"))
    inside = Window.partitionBy("gen").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("gen").rowsBetween(Window.unboundedPreceding, -1)
    sizes = m.groupBy("gen").agg(F.sum("n").alias("total")).select("gen", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return m.join(sizes, "gen").select("seq", (8 + F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).cast("long").alias("payload_offset"))


_OPS = """z as (select event_id as seq, case when event_id % 5 = 0 then 'ADD' when event_id % 5 = 1 then 'DELETE' when event_id % 5 = 2 then 'DELETE_IF_EXISTS' when event_type = 'error' then 'TOMBSTONE' else 'UPSERT' end as op, lpad(cast(user_id as varchar), 10, '0') as "key", props as value from events),
y as (select *, coalesce(max(case when op in ('ADD', 'UPSERT', 'TOMBSTONE') then 1 else 0 end) over w, 0) = 1 as known, coalesce(last_value(case when op in ('ADD', 'UPSERT') then true else false end) over w, false) as put from z window w as (partition by "key" order by seq rows between unbounded preceding and 1 preceding)),
x as (select *, case when op = 'ADD' and known and put then 'KEY_EXISTS' when op = 'DELETE' and not known then 'KEY_NOT_FOUND' end as error from y),
v as (select *, case when error is not null then null when op in ('ADD', 'UPSERT') then 'PUT' when op = 'TOMBSTONE' or known then 'DEL' end as effect from x)"""


@query("with " + _OPS + ' select seq, op, "key", error, effect from v where op like \'DELETE%\'')
def delete_semantics(spark, d):
    return memstore.judged(_ops(spark, d)).where("op like 'DELETE%'").select("seq", "op", "key", "error", "effect")


@query("with " + _OPS + ' select seq, "key", error from v where op = \'ADD\' and error is not null')
def add_conflicts(spark, d):
    return memstore.judged(_ops(spark, d)).where("op = 'ADD' and error is not null").select("seq", "key", "error")


@query("with " + _OPS + ', s as (select "key", case when effect = \'PUT\' then value end as value, row_number() over (partition by "key" order by seq desc) as rn from v where effect is not null) select "key", value from s where rn = 1')
def memstore_state(spark, d):
    return memstore.state(_ops(spark, d))


@query("with " + _OPS + ', s as (select "key", case when effect = \'PUT\' then value end as value, row_number() over (partition by "key" order by seq desc) as rn from v where effect is not null) select "key", value from s where rn = 1 and value is not null')
def memstore_flush(spark, d):
    return memstore.flush(memstore.state(_ops(spark, d)))


@query(_with(M, select="select lpad(cast(seq // 2500 as varchar), 6, '0') || '.wal' as segment, count(*) as n, min(seq) as first_seq, max(seq) as last_seq from m group by 1"))
def wal_segments(spark, d):
    name = F.concat(F.lpad(F.floor(F.col("seq") / 2500).cast("string"), 6, "0"), F.lit(".wal"))
    return _log(spark, d).groupBy(name.alias("segment")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("select event_id, row_number() over (order by lpad(cast(event_id // 2500 as varchar), 6, '0'), event_id) as seq from events")
def wal_replay_order(spark, d):
    e = _read(spark, d, "events").select("event_id", F.lpad(F.floor(F.col("event_id") / 2500).cast("string"), 6, "0").alias("segment"))
    return versions.sequenced(e, "segment", "event_id").select("event_id", "seq")


_HISTORY = """h as (select event_id as seq, cast(user_id as varchar) as "key", case when event_type = 'click' then 'get' when event_type = 'error' then 'del' else 'put' end as op, props as val from events),
g as (select *, last_value(case when op = 'put' then struct_pack(v := val) when op = 'del' then struct_pack(v := cast(null as varchar)) end ignore nulls) over (partition by "key" order by seq rows between unbounded preceding and 1 preceding) as e from h)"""


@query("with " + _HISTORY + ' select seq, "key", e.v as expected from g where op = \'get\'')
def read_after_write_check(spark, d):
    e = _read(spark, d, "events")
    op = F.when(F.col("event_type") == "click", "get").when(F.col("event_type") == "error", "del").otherwise("put")
    h = e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), op.alias("op"), F.col("props").alias("val"), F.lit(None).cast("string").alias("err"), F.col("event_id").alias("call_ns"))
    return history.sequential(h).select("seq", "key", "expected")


def _crc64_sql() -> str:
    """The checksum byte by byte, by a table of its polynomial."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xD800000000000000 if c & 1 else 0)
        table.append(c)
    ones = f"{2**64 - 1}::ubigint"
    steps = f"list_reduce(list_prepend({ones}, bytes), lambda c, b: xor(c >> 8::ubigint, t[cast(xor(c & 255::ubigint, b) as integer) + 1]))"
    return _with(O, f", k as (select [{', '.join(f'{x}::ubigint' for x in table)}] as t), v as (select \"key\", list_transform(range(1, strlen(value) + 1), lambda i: cast(ascii(substr(value, i, 1)) as ubigint)) as bytes from o)", select=f'select "key", hex(xor({steps}, {ones})) as checksum from v, k')


@query(_crc64_sql())
def value_checksums(spark, d):
    """CRC-64 of each value, as sorted tables store it."""
    from ..functions.codecs import crc64_iso_udf

    return _orders(spark, d).select("key", F.hex(crc64_iso_udf(F.encode("value", "UTF-8"))).alias("checksum"))


@query(_with(O, select="select hex(encode(\"key\")) as key_hex, value from o"))
def key_bytes(spark, d):
    from ..functions.keys import text_key

    return _orders(spark, d).select(F.hex(text_key(F.col("key"))).alias("key_hex"), "value")


@query("select o_orderkey, lpad(hex(o_orderkey), 8, '0') as key_hex from orders")
def int_keys(spark, d):
    from ..functions.keys import int_key

    return _read(spark, d, "orders").select("o_orderkey", F.hex(int_key(F.col("o_orderkey"), 4)).alias("key_hex"))


# --- the native sources: written by the library's writers into the shared folder and read back


def _folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, or below a temporary folder where that is unset (tests)."""
    import atexit
    import shutil
    import tempfile
    import uuid

    from ..sources import records

    records.register(spark)
    base = (spark.conf.get("spark.checkpoint.dir", "") or "").removeprefix("file://")
    path = f"{base or tempfile.gettempdir()}/native-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def _bytes(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.encode(c, "UTF-8") for c in ("key", "value")})


def _text(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"), *more)


@query(_with(O, select="select * from o"))
def native_records(spark, d):
    """Compressed record files, written side by side and scanned in splits."""
    path = _folder(spark)
    o = _orders(spark, d).select(F.encode(F.concat_ws("|", "key", "value"), "UTF-8").alias("record"))
    o.write.format("records").option("compression", "snappy").mode("append").save(path)
    parts = F.split(F.decode("record", "UTF-8"), r"\|")
    return spark.read.format("records").option("splitBytes", 1 << 20).load(path).select(parts[0].alias("key"), parts[1].alias("value"))


@query(_with(M, ', r as (select *, row_number() over (partition by "key" order by seq desc) as rn from m)', select='select "key", value from r where rn = 1'))
def native_log_replay(spark, d):
    """The log as native segments of mutations, replayed: the latest version of each key, tombstones included."""
    from ..sources import records

    path = _folder(spark)
    log = _bytes(_log(spark, d)).select(F.col("gen").cast("int").alias("segment"), "seq", "key", "value").repartition("segment").sortWithinPartitions("segment", "seq")
    records.encode_mutations(log).write.format("log").mode("append").save(path)
    rows = records.decode_mutations(spark.read.format("log").load(path))
    return _text(versions.keep_latest(versions.from_mutations(rows), "seq"))


def _native(spark, d) -> DataFrame:
    from ..sources import records

    path = _folder(spark)
    records.save_tables(_bytes(_tables(spark, d)), path)
    return spark.read.format("sortedtable").load(path)


@query(_with(T_, select="select \"key\", value, cast(dense_rank() over (order by gen) - 1 as bigint) as gen from t"))
def native_table_scan(spark, d):
    """Native sorted tables, one a generation, read back with their checksums checked."""
    return _text(_native(spark, d), "gen")


@query(_with(T_, select="select \"key\", value from (select *, row_number() over (partition by \"key\" order by gen desc) as rn from t) where rn = 1 and value is not null and \"key\" between '0000000010' and '0000000050'"))
def native_table_range(spark, d):
    """A key range of stacked native tables; the index is searched and left early."""
    low, high = (F.lit(bytearray(b"0000000010")), F.lit(bytearray(b"0000000050")))
    return _text(versions.live(_native(spark, d).where((F.col("key") >= low) & (F.col("key") <= high)).select("key", "value", "gen")))


@query(_with(T_, select="select \"key\", value, cast(dense_rank() over (order by gen) - 1 as bigint) as gen from t qualify \"key\" = '0000000007'"))
def native_table_get(spark, d):
    """One key of all native tables; a table whose Bloom filter lacks it isn't searched."""
    return _text(_native(spark, d).where(F.col("key") == F.lit(bytearray(b"0000000007"))), "gen")
