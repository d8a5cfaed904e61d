import random
import re
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tidemark.llm import common, mixing


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    vocab = {"aa": ["tion", "the", "ing", "wher", "or"], "bb": ["ñado", "que", "los", "mente", "ar"]}

    def text(lang, n):
        return " ".join("".join(rng.choices(vocab[lang], k=rng.randint(2, 5))) for _ in range(n))

    rows = []
    for i in range(60):
        lang = rng.choice(["aa", "bb"])
        rows.append([i, "\n".join(text(lang, 40) for _ in range(3)), lang])
    bench = text("aa", 14)
    near = rows[1][1].split(" ")
    near[3] = near[50] = near[90] = "tiontion"
    rows += [[100, rows[0][1], rows[0][2]], [101, " ".join(near), rows[1][2]], [102, "123 456", "aa"], [103, None, "aa"], [104, text("aa", 30) + " " + bench, "aa"], [105, text("bb", 30) + "\n" + rows[7][1].split("\n")[1], "bb"]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, g, rng.choice(["s1", "s2", None]), len(t or "")) for d, t, g in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        out = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
        seen[name], docs = {r.doc_id: r for r in out.collect()}, out
    clean = set(range(60))
    assert set(seen["language_id"]) == clean | {100, 101, 104, 105}
    assert set(seen["line_dedup"]) >= clean | {104, 105} and 100 not in seen["line_dedup"]
    assert "\n" not in seen["line_dedup"][105].text and seen["line_dedup"][105].n_chars == len(seen["line_dedup"][105].text)
    before = [(d, r.text) for d, r in seen["line_dedup"].items()]
    assert set(seen["near_dedup"]) == {d for d, _, _, kept in brute.near_duplicates(before, 5, 80) if kept}
    assert set(seen["decontamination"]) == set(seen["near_dedup"]) - {104}
    last = seen["source_mixing"]
    assert set(last) <= set(seen["decontamination"]) and all(r.taken > 0 for r in last.values())
    assert len(last) > 0.5 * len(seen["decontamination"])
    for s in {r.source for r in last.values()}:
        of = [r for r in last.values() if r.source == s]
        assert abs(sum(r.taken for r in of) - of[0].target) <= 128 and all(r.taken <= 2 * r["size"] for r in of)
    assert docs.where(F.col("text").isNull()).count() == 0


def test_rows_of_one_doc_id(spark, tmp_path):
    t = " ".join(f"w{i}" for i in range(40))
    u = " ".join(f"u{i}" for i in range(40))
    v = t.replace("w39", "x")
    leaked = " ".join(f"b{i}" for i in range(12))
    rows = [(1, t), (1, t), (2, t), (3, "x"), (3, "another text"), (None, t), (4, None), (5, ""), (6, t), (6, u), (7, v), (7, "a b"), (8, u + " z"), (8, u + " y"), (9, leaked), (9, "clean"), (None, leaked)]
    docs = spark.createDataFrame([(*r, "h", 1) for r in rows], "doc_id long, text string, hash string, owner int")
    got = sorted((tuple(r)[:2] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, t), (3, "x"), (3, "another text"), (None, t), (4, None), (5, ""), (6, u), (7, "a b"), (9, leaked), (9, "clean"), (None, leaked)], key=str)
    # two near duplicates of one id: one of them stays
    twins = docs.where("doc_id = 8")
    assert len(corpus_pipeline.near_dedup(spark, twins, "").collect()) == 1
    spark.createDataFrame([(1, leaked)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((tuple(r)[:2] for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()), key=str)
    assert got == sorted([r for r in rows if r[1] != leaked], key=str)


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []


def test_mix_goes_through_the_tree(spark):
    """Shards hold the tree's quotas by source, their places are all taken once, and draws make up what is taken."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(1 + i * 37 % 900)), ["a", "b", None][i % 3]) for i in range(90)] + [(None, "a b", "b"), (7, None, "a"), (8, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.source_mixing(spark, docs, None).collect()
    mix = mixing.Mix(docs)
    quotas = mixing.split(mix.quotas, mixing.LEAST_SHARDS, mix.seed)
    draws = [(d.shard, d.position, r.source, min(256, r.size - 256 * d.block)) for r in got for d in r.draws]
    for shard in range(mixing.LEAST_SHARDS):
        here = [d for d in draws if d[0] == shard]
        assert [sum(d[2] == s for d in here) for s in mix.sources] == quotas[shard].tolist()
        assert sorted(d[1] for d in here) == list(range(len(here)))
    assert len(draws) == sum(mix.quotas)
    for r in got:
        assert r.text and r.n_draws == len(r.draws) > 0
        assert r.taken == sum(min(256, r.size - 256 * d.block) for d in r.draws)
        assert len({(d.block, d["pass"]) for d in r.draws}) == len(r.draws)
    assert sorted((str(r.doc_id), r.size, r.taken) for r in got) == sorted((str(r.doc_id), r.size, r.taken) for r in mix.taken().where("taken > 0").collect())


def test_mix_shuffles_no_text(spark, monkeypatch):
    """Draws beyond the broadcast bound meet their rows without a shuffle of these, with the same result."""
    rows = [(i % 300, " ".join(f"w{i}x{j}" for j in range(i * 37 % 900)) if i % 11 else None, ["a", "b", None][i % 3], i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, d_lot int").repartition(3)
    want = sorted(map(str, corpus_pipeline.source_mixing(spark, docs, None).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 10, raising=False)
    monkeypatch.setattr(mixing, "LOT", 16, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.source_mixing(spark, docs, None)
        plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert sorted(map(str, out.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffled = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert shuffled and not any("text#" in x for x in shuffled)


def test_stages_leave_no_tables_behind(spark, tmp_path):
    """A stage's result stands on a table or two of what it found; those on the way are gone when it is returned."""
    text = [" ".join(f"w{i // 2}x{j}" for j in range(60)) + f"\nline {i % 7} of words that are the same" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    spark.createDataFrame([(1, text[3][:200])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    root = Path(common.shared_dir(spark).removeprefix("file://"))
    tables = lambda: {p for p in root.glob("*/*") if p.is_dir()}
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_dedup, corpus_pipeline.decontamination):
        before = tables()
        out = stage(spark, docs, str(tmp_path))
        assert 1 <= len(tables() - before) <= 2
        assert 0 < out.count() <= 40
