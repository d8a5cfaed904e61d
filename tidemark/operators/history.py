"""Consistency of recorded operations on a map (HISTORY rows), key by key."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sequential(history: DataFrame) -> DataFrame:
    """For histories whose operations don't overlap: each get with the value it should have seen, and ok."""
    w = Window.partitionBy("key").orderBy("call_ns").rowsBetween(Window.unboundedPreceding, -1)
    put = F.when(F.col("op") == "put", F.struct(F.col("val").alias("v"))).when(F.col("op") == "del", F.struct(F.lit(None).cast("string").alias("v")))
    expected = F.last(put, True).over(w)["v"]
    out = history.withColumn("expected", expected).where("op = 'get'")
    return out.withColumn("ok", F.col("expected").eqNullSafe(F.when(F.col("err").isNull(), F.col("val"))))


def _linearizable(ops: list[tuple]) -> bool:
    """ops (call, return, op, val, missing): whether some order within the intervals explains every result."""
    ops = sorted(ops)
    n, seen = len(ops), set()
    stack = [(0, None)]
    while stack:
        done, value = stack.pop()
        if done == (1 << n) - 1:
            return True
        if (done, value) in seen:
            continue
        seen.add((done, value))
        limit = min(ops[i][1] for i in range(n) if not done >> i & 1)
        for i in range(n):
            call, _, op, val, missing = ops[i]
            if done >> i & 1 or call > limit:
                continue
            if op == "get" and (value is not None if missing else val != value):
                continue
            stack.append((done | 1 << i, val if op == "put" else None if op == "del" else value))
    return False


def linearizable(history: DataFrame) -> DataFrame:
    """key, ok: each key is checked by itself, which is enough for a map.  A key's history must fit a task."""

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        ops = [(r.call_ns, r.return_ns, r.op, None if pd.isna(r.val) else r.val, not pd.isna(r.err)) for r in pdf.itertuples()]
        return pd.DataFrame({"key": pd.Series([pdf["key"].iloc[0]], dtype=object), "ok": [_linearizable(ops)]})

    return history.groupBy("key").applyInPandas(check, "key string, ok boolean")
