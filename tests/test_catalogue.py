"""Queries of the catalogue against plain Python, on tables with more generations and keys than the smallest ones."""

import pytest

from tidemark.plans import catalogue

N_EVENTS, N_KEYS, N_CUSTOMERS = 23_000, 230, 260


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("kv"))
    # the keys of each generation differ; an empty props is a value
    events = [(i, (i * 7 + i // 1000 * 31) % N_KEYS if i // 1000 % 3 else i % 90, "error" if i % 11 == 0 else "view", "" if i % 13 == 0 else f"p{i}") for i in range(N_EVENTS)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, props string").write.parquet(f"{d}/events.parquet")
    spark.createDataFrame([(k,) for k in range(N_CUSTOMERS)], "c_custkey long").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(k, f"{k % 5}-X") for k in range(1, 1200)], "o_orderkey long, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    return d, events


def key(k):
    return f"{k:010d}"


def stores(events):
    """The newest version of each key by generation."""
    out = {}
    for i, user, kind, props in events:
        out.setdefault(i // 1000, {})[user] = None if kind == "error" else props
    return out


def test_layers_of_the_whole_log(spark, made):
    d, events = made
    by_gen = stores(events)
    latest = {k: v for g in sorted(by_gen) for k, v in by_gen[g].items()}
    got = {r["key"]: (r.status, r.value) for r in catalogue.QUERIES["kv_layered_get"](spark, d).collect()}
    state = lambda k: ("NOT_FOUND", None) if k not in latest or latest[k] == "" else ("TOMBSTONED", None) if latest[k] is None else ("FOUND", latest[k])
    assert got == {k: state(int(k)) for k in got} and len({s for s, _ in got.values()}) == 3
    write, read = by_gen[max(by_gen)], by_gen[max(by_gen) - 1]
    got = {r["key"]: (r.either, r.live) for r in catalogue.QUERIES["rw_contains"](spark, d).collect()}
    live = lambda k: write[k] is not None if k in write else read.get(k) is not None
    assert got == {k: (write.get(int(k)) is not None or read.get(int(k)) is not None, live(int(k))) for k in got}
    assert len(set(got.values())) > 1


def test_every_customer_is_looked_up_and_every_order_encoded(spark, made):
    d, events = made
    latest = {user: None if kind == "error" else props for _, user, kind, props in events}
    rows = lambda name: [tuple(r) for r in catalogue.QUERIES[name](spark, d).collect()]
    state = lambda k: ("NOT_FOUND", None) if k not in latest else ("TOMBSTONED", None) if latest[k] is None else ("FOUND", latest[k])
    assert sorted(rows("kv_multi_get")) == [(key(k), *state(k)) for k in range(N_CUSTOMERS)]
    assert sorted(rows("kv_contains")) == [(key(k),) for k in range(N_CUSTOMERS) if k in latest]
    assert sorted(rows("kv_missing")) == [(key(k),) for k in range(N_CUSTOMERS) if k not in latest]
    for name in ("kv_layered_get", "rw_contains"):
        assert sorted(r[0] for r in rows(name)) == [key(k) for k in range(N_CUSTOMERS)]
    assert sorted(rows("key_bytes")) == [(key(k).encode().hex().upper(), f"{k % 5}-X") for k in range(1, 1200)]
