import hashlib
import json
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import chat, components, decontaminate, langid, licenses, mixing, tokens, topk, urlfilter
from tidemark.llm.common import Workspace

BPE = public_tokenizers.path("byte_bpe_50k.json")


# --- op1


def test_licenses(spark):
    rows = [
        (1, "ordinary words of a text\nLicensed under the Apache License, Version 2.0.\nmore words"),
        (2, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."),
        (3, "no licence here, only the words of a text"),
        (4, "Licensed under the Zebra Grass License."),
        (5, None), (6, ""), (7, " \n\n"), (7, " \n\n"), (None, "Released under the MIT License."),
        (8, "This work is licensed under the GNU General Public License, version 3."),
        (9, "the word " * 20000 + "\nReleased under the MIT License."),
    ]
    ordinary = ["ordinary words of a text", "more words and the rest of it", "only the words", "the word is here"]
    model = licenses.fit(ordinary * 5)
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, rid int, license string")
    got = sorted(((r.doc_id, r.n_paragraphs, r.license) for r in licenses.license_scan(df, model).collect()), key=str)
    want = [(1, 3, "Apache-2.0"), (2, 2, "CC-BY-NC-4.0,MIT"), (3, 1, None), (4, 1, "unknown"), (5, 0, None), (6, 0, None), (7, 0, None), (7, 0, None), (None, 1, "MIT"), (8, 1, "GPL-3.0"), (9, 2, "MIT")]
    assert got == sorted(want, key=str)
    assert licenses.license_scan(df.limit(0)).collect() == []


def test_license_scores_match_numpy(spark):
    texts = [n for ns in licenses.NOTICES.values() for n in ns] + ["an ordinary line", "License of the word"]
    model = licenses.fit(["an ordinary line of words"] * 3)
    found = licenses.scan(Workspace(spark, "t"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).where("par >= 0").collect()
    p = model.probabilities(texts)
    best = {i: (licenses.CLASSES[k], p[i, k]) for i, k in enumerate(p.argmax(1)) if k}
    assert {r.doc_id for r in found} == set(best)
    for r in found:
        assert abs(r.score - best[r.doc_id][1]) < 1e-5
    right = sum(best.get(i, ("none",))[0] == f for i, f in enumerate(f for f, ns in licenses.NOTICES.items() for _ in ns))
    assert right == len(texts) - 2


def test_license_scan_brute_force(spark):
    """Every paragraph scored in numpy, runs and overlaps in plain Python."""
    rng = random.Random(6)
    ordinary = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "text", "of", "the", "and", "to", "in", "work"], k=rng.randint(1, 15))) for _ in range(300)]
    model = licenses.fit(ordinary, epochs=10)
    notices = [n for ns in licenses.NOTICES.values() for n in ns] + [n.format("zebra", "9") for n in licenses.OTHERS] + list(licenses.UNSEEN)

    def wrapped(n):
        words = n.split()
        return "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))

    docs = []
    for i in range(150):
        lines = [rng.choice(ordinary) for _ in range(rng.randint(0, 4))] + [rng.choice([str, wrapped])(rng.choice(notices)) for _ in range(rng.randint(0, 2))] + rng.choices(["", "  "], k=rng.randint(0, 1))
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines)))

    def want(text):
        n, found = 0, []
        for par, line in enumerate(text.split("\n")):
            words = licenses.paragraph_words(line)
            n += bool(words)
            if any(g in set(model.features) for g in licenses.grams(words)):
                p = model.probabilities([line])[0]
                if p.argmax():
                    at = [i for i, f in enumerate(model.features) if f in licenses.grams(words)]
                    found.append((par, licenses.CLASSES[p.argmax()] if p.max() >= model.threshold else "other", licenses.template(line), model.weights[at].sum(0)))
        runs = []
        for one in found:
            if runs and runs[-1][-1][0] == one[0] - 1:
                runs[-1].append(one)
            else:
                runs.append([one])
        sure = set()
        for run in runs:
            families, open_ = {f for _, f, *_ in run}, [z for _, f, _, z in run if f == "other"]
            if len(open_) > 1:
                p = licenses.softmax((sum(open_) + model.bias)[None] / model.temperature)[0]
                families |= {licenses.CLASSES[p.argmax()]} if p.argmax() > 1 and p.max() >= model.threshold else set()
            two = set().union(*(t for _, _, t, _ in run))
            sure |= {f for f in families for n in licenses.NOTICES.get(f, ()) if len(licenses.template(n) & two) >= 0.6 * len(licenses.template(n))}
        return n, len(found), ",".join(sorted(sure)) or ("unknown" if found else None)

    got = {r.doc_id: (r.n_paragraphs, r.n_license, r.license) for r in licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert got == {d: want(t) for d, t in docs}
    assert len({x for *_, x in got.values()}) > 8


def test_unseen_and_wrapped_licences(spark):
    rng = random.Random(8)
    ordinary = [" ".join(rng.choices(["alpha", "beta", "gamma", "text", "of", "the", "and", "this", "is", "work", "by"], k=rng.randint(1, 15))) for _ in range(400)]
    model = licenses.fit(ordinary)
    unseen = ["Licensed under the Academic Free License version 3.0", "This work is licensed under the Zebra Public License, version 7.", "Distributed under the terms of the Quantum Source License", "Released under the Open Publication License 1.0"]
    gpl = next(n for n in licenses.NOTICES["GPL-3.0"] if n.startswith("This program is free"))
    words = gpl.split()
    wrapped = "\n".join(" ".join(words[i : i + 11]) for i in range(0, len(words), 11))
    got = {r.doc_id: r.license for r in licenses.license_scan(spark.createDataFrame(list(enumerate([*unseen, wrapped, ordinary[0]])), "doc_id long, text string"), model).collect()}
    assert all(got[i] in ("unknown", None) for i in range(4)) and sum(got[i] == "unknown" for i in range(4)) >= 3
    assert got[4] == "GPL-3.0" and got[5] is None


# --- op2


@pytest.mark.parametrize("spread", [1, 40, 10**6])
def test_topk(spark, spread):
    rng = random.Random(2)
    rows = [(i, [round(rng.gauss(0, 1) * spread, 3) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (304, [1.0] * 5), (350, rows[0][1]), (305, rows[7][1]), (306, rows[7][1]), (5, rows[7][1]), (307, [])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert got == sorted(want)


def test_topk_stops_early_with_the_same_result():
    rng = np.random.default_rng(4)
    rows = np.floor(rng.normal(0, 8, (2000, 4)))
    rows[:20] *= 6
    q = rows[:40]
    found = topk.block_topk(q, np.arange(40), rows, np.arange(2000), 5)
    for i in range(40):
        s = rows @ q[i]
        s[i] = -np.inf
        want = sorted(range(2000), key=lambda j: (-s[j], j))[:5]
        assert [j for k, j, _ in found if k == i] == want
    assert topk.block_topk(q, np.arange(40), rows[:3], np.arange(3), 5)


def test_topk_in_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 8).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, topk.exact_topk(df, every=9).collect()))
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 5)
    assert sorted(map(tuple, topk.exact_topk(df, every=9).collect())) == whole and len(whole) == 5 * 45


def test_topk_empty(spark):
    assert topk.exact_topk(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# --- op3


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 50)
    monkeypatch.setattr(mixing, "BIN", 7)
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([0, 1, 30, 300, 2000]), rng.choice(["b", "a", "a", "a", None, "é"])) for i in range(200)]
    rows += [(500, None, "a"), (501, "", "empty"), (None, "a b", "a"), (7, "x", "a"), (7, "x", "a"), (502, "one two", "tiny")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, rid int")
    got = mixing.Mix(df).drawn().collect()
    assert len(got) == len(rows)
    sizes = {}
    for d, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.spaced_words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == want[r.source] and 0 <= r.taken <= 2 * r["size"]
    for s in order:
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= mixing.BLOCK / 2 + 1
    plain = lambda rows: sorted(str({k: v for k, v in r.asDict().items() if k != "rid"}) for r in rows)
    assert plain(got) == plain(mixing.Mix(df.repartition(5)).drawn().collect())
    # the draws of the tree's shards, and the cuts alone, take the same
    shared = ("rid", "doc_id", "source", "size", "source_size", "target", "taken", "n_draws")
    assert sorted(str([r[c] for c in shared]) for r in mixing.Mix(df).taken().collect()) == sorted(str([r[c] for c in shared]) for r in got)
    assert set(mixing.Mix(df, extra=["text", "rid"]).taken().columns) == {*shared, "text"}
    draws = mixing.Mix(df).draws(5).collect()
    keys = [(r.rid, r.block, r["pass"]) for r in draws]
    assert len(set(keys)) == len(keys)
    for k in range(5):
        assert sorted(r.position for r in draws if r.shard == k) == list(range(sum(r.shard == k for r in draws)))
    per = [sum(r.shard == k for r in draws) for k in range(5)]
    assert max(per) - min(per) <= 2
    assert mixing.Mix(df.limit(0)).drawn().collect() == []


def test_targets_and_tree():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([200, 250 * 2 / 3, 250 / 3])
    assert mixing.targets([0, 10], [5, 2]) == [0.0, 15.0]
    assert sum(mixing.targets([10, 500, 40, 3], [5, 2, 1, 5])) == pytest.approx(1.5 * 553)
    quotas = [1000, 10, 0, 5 * 10**9]
    tree = mixing.split(quotas, 7, 1)
    assert tree.sum(0).tolist() == quotas and tree.min() >= 0 and np.ptp(tree.sum(1)) <= 7
    many = np.array([mixing.split([60, 40], 2, s)[0, 0] for s in range(400)])
    assert abs(many.mean() - 30) < 0.5 and 4 < many.var() < 8  # 50 * 0.6 * 0.4 * 50 / 99 = 6.06


# --- op4


def test_chat(spark):
    tools = {"tools": [{"name": "add", "parameters": {"required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "number"}}}}]}
    call = lambda *calls: json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "depends_on"), c)) for c in calls]})
    result = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [
        (1, 0, "system", json.dumps(tools)),
        (1, 1, "assistant", call(("x", "add", {"b": 1.5, "a": 2}))),
        (1, 2, "tool", result("x", {"z": 1, "a": [3, "é"]})),
        (1, 3, "assistant", call(("y", "add", {"a": "two"}), ("w", "sub", {}))),
        (1, 4, "tool", result("x", 2)),
        (1, 5, "tool", result("nobody", 2)),
        (1, 6, "assistant", call(("x", "add", {"a": 1}))),
        (2, 0, "tool", result("q", 1)),  # before its call
        (2, 1, "assistant", call(("q", "any", {}, ["r"]))),
        (2, 2, "assistant", call(("r", "any", {}))),
        (2, 3, "tool", result("r", 1)),
        (2, 4, "assistant", call(("c1", "f", {}, ["c2"]), ("c2", "f", {}, ["c1"]))),
        (3, 0, "user", 'He said "hi"\n{not json'), (3, 1, None, None), (None, None, "user", ""), (3, 2, "assistant", "{broken"), (3, 2, "assistant", "{broken"), (3, 3, "user", "x" * 200000),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, mid int")
    got = chat.format_chats(df).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 1].status == "ok" and by[1, 1].n_linked == 1
    assert by[1, 1].json == '{"role":"assistant","tool_calls":[{"arguments":{"a":2,"b":1.5},"id":"x","name":"add"}]}'
    assert by[1, 2].json == '{"content":{"a":[3,"é"],"z":1},"role":"tool","tool_call_id":"x"}' and by[1, 2].status == "ok"
    assert by[1, 3].status == "unknown_tool" and by[1, 3].n_invalid == 2
    assert [by[1, k].status for k in (4, 5, 6)] == ["repeated", "orphan", "duplicate"]
    second = sorted((r for r in got if r.conv_id == 2), key=lambda r: (r.anchor, r.level, r.step, r.turn))
    assert [r.turn for r in second][:5] == [2, 3, 1, 0, 4] or [r.turn for r in second if r.turn < 4] == [2, 3, 1, 0]
    assert by[2, 4].status == "cycle"
    assert json.loads(by[3, 0].json) == {"content": 'He said "hi"\n{not json', "role": "user"}
    assert by[3, 1].json == "{}" and by[None, None].json == '{"content":"","role":"user"}'
    assert all(json.loads(r.json) is not None for r in got)
    assert chat.format_chats(df.limit(0)).collect() == []


# --- op5


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST, 0])
def test_decontaminate(spark, monkeypatch, broadcast):
    """Also by shuffling what is too much to be broadcast."""
    monkeypatch.setattr(decontaminate, "BROADCAST", broadcast)
    rng = random.Random(6)
    vocab = ["a", "the", "of", "naïve", "x1", "zebra", "so"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 4, 9, 10, 14, 30])))) for i in range(25)] + [(30, None), (31, "..."), (None, "alpha beta gamma"), (32, "A, THE. of!"), (32, "A, THE. of!")]
    docs = []
    for i in range(60):
        words = rng.choices(vocab + [f"r{j}" for j in range(40)], k=rng.randint(0, 60))
        if rng.random() < 0.5:
            at = rng.randrange(len(words) + 1)
            words[at:at] = (rng.choice(items)[1] or "").split()[rng.choice([0, 0, 1]) :]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(words).title()))
    docs += [(100, None), (101, ""), (102, "!!"), (None, "alpha BETA gamma"), docs[3], docs[3], (103, "the " * 30000)]
    split = lambda t: "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in brute.ascii_lower(t or "")).split(" ")
    words_of = lambda t: [w for w in split(t) if w]
    windows = {}
    for i, t in items:
        w = words_of(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add(i)
    want = []
    for d, t in docs:
        w, hit, ids = words_of(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if (found := windows.get(tuple(w[s : s + k]))) is not None:
                    hit.update(range(s, s + k))
                    ids |= {str(i) for i in found if i is not None}
        want.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    df = spark.createDataFrame([(*r, 0, "w") for r in docs], "doc_id long, text string, rid int, w string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.decontaminate(df, it).collect()), key=str)
    assert got == sorted(want, key=str)
    assert decontaminate.decontaminate(df.limit(0), it).collect() == []
    assert not any(r.contaminated for r in decontaminate.decontaminate(df, it.limit(0)).collect())


# --- op6


def test_tokens(spark):
    rng = random.Random(1)
    parts = [*"ab1 .'\n\té²—  <|>s‍漢😀", "<|endoftext|>", " the", "'s", " word", "."]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 80))) for _ in range(3000)] + ["", "no boundary" * 50, " a" * 500]
    plain = tokens.Counter(BPE).batch(texts)
    for chunk, overlap in ((30, 6), (200, 20), (1 << 16, 256)):
        count = tokens.Counter(BPE, chunk, overlap)
        assert [n for i in range(0, len(texts), 64) for n in count.counts(texts[i : i + 64])] == plain
    rows = list(enumerate(texts[:50])) + [(None, None), (1, texts[1])]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_tokens int")
    got = tokens.token_counts(df, BPE, limit=20, chunk=40, overlap=8).collect()
    assert [(r.doc_id, r.n_tokens, r.over_limit, r.n_bytes) for r in got] == [(d, n, n > 20, len((t or "").encode())) for (d, t), n in zip(rows, [*plain[:50], 0, plain[1]])]
    assert tokens.token_counts(df.limit(0), BPE).collect() == []


def test_splices_happen():
    count = tokens.Counter(BPE, 100, 20)
    assert count.proven
    seen = []
    find = count.splice
    count.splice = lambda *a: seen.append(find(*a)) or seen[-1]
    text = "some words that go on and on " * 40
    assert count.long(text) == count.batch([text])[0] and len([x for x in seen if x]) > 8


def test_pieces_model(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame([(1, "some words"), (2, "")], "doc_id long, text string")
    assert [r.n_tokens for r in tokens.token_counts(df, path).collect()] == [len(model.encode("some words")), 0]


# --- op7


def test_urls(spark):
    rng = random.Random(9)
    hosts = ["example.com", "www.example.com", "a.www.Example.COM", "notexample.com", "x.net", "net", "x.org", "com", "", "com.org"]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}{rng.choice(['://', '://', ':/'])}{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/1', '/es/x', '/fr', '/fr/', '/en'])}{rng.choice(['', '?q=/es/', '#a', '?u=http://x.com/'])}" for _ in range(400)] + [None, "", "://", "a://b://c"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://x.net/es/", "h"), (3, urls[3], "h")], "page_id long, url string, host string")

    def want(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = brute.ascii_lower(rest[:end]), rest[end:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        return host, path, rule, verdict

    for r, (u,) in zip(urlfilter.url_filter(df).collect(), df.select("url").collect()):
        assert (r.host, r.path, r.rule, r.verdict) == want(u)
    assert urlfilter.url_filter(df.limit(0)).collect() == []
    assert {r.verdict for r in urlfilter.url_filter(df, rules=()).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = urlfilter.build(Workspace(spark, "t"), keys)
    assert len(cascade.levels) > 1
    rows = keys.select("listed", cascade.hashes(F.col("key")).alias("b")).collect()
    assert cascade.listed(np.array([r.b for r in rows])).tolist() == [r.listed for r in rows]
    # the size follows the list, not the universe
    few = urlfilter.build(Workspace(spark, "t"), spark.range(100_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") < 5).alias("listed")))
    assert sum(len(level.bits) for level in few.levels) < 1000


def test_many_rules(spark):
    rng = random.Random(2)
    rules = {(f"{rng.choice('abc')}{rng.randint(0, 40)}.{rng.choice(['com', 'org', 'x.net'])}", "/" + rng.choice(["", "p/", "p/q/", "é"])): rng.choice(["allow", "block"]) for _ in range(150)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"http://{rng.choice(['', 'www.', 'é.'])}{rng.choice('abc')}{rng.randint(0, 60)}.{rng.choice(['com', 'org', 'x.net'])}/{rng.choice(['', 'p/', 'p/q/r', 'é?'])}" for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in urlfilter.url_filter(df, rules=tuple(rules), default="allow").collect():
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert (r.rule, r.verdict) == (rule, verdict)


# --- op8


def test_languages(spark):
    rng = random.Random(12)
    words = {"aa": ["tion", "the", "ing", "wher"], "bb": ["ñado", "que", "los", "mente"], "cc": ["über", "sch", "und", "keit"]}
    rows = [(i, " ".join("".join(rng.choices(words[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 80))), lang) for i, lang in enumerate(rng.choices(list(words), k=400))]
    extra = [(1000, None, "aa"), (1001, "12 34 !", "bb"), (1002, "", None), (None, rows[0][1], "aa"), rows[5]]
    df = spark.createDataFrame([(*r, "z") for r in rows + extra], "doc_id long, text string, lang string, score string")
    model = langid.train(df.where(~langid.held_out()))
    got = langid.predict(df, model, "lang", langid.held_out().alias("held_out")).collect()
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(held) > 40 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) and sum(r.rejected for r in held) <= 1
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (1000, 1001, 1002))
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows) + len(extra)
    again = langid.train(df.repartition(3).where(~langid.held_out()))
    assert np.array_equal(model.table, again.table)
    assert langid.predict(df.limit(0), model).collect() == []
    # extra columns named like results give way, and a very long text is one text
    clash = df.limit(20).withColumns({"lang_pred": F.lit(1), "text of the row": F.lit(2)})
    assert [tuple(r) for r in langid.predict(clash, model, "score", "lang_pred", "text of the row").select("doc_id", "lang_pred").collect()] == [(r.doc_id, r.lang_pred) for r in langid.predict(df.limit(20), model).collect()]
    long = spark.createDataFrame([(1, " ".join(r[1] for r in rows if r[2] == "bb") * 20)], "doc_id long, text string")
    assert langid.predict(long, model).first().lang_pred == "bb"
    empty = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, empty).collect()} == {"und"}


def test_training_takes_little_memory_of_the_driver(spark):
    """Features come as bytes, not as a Python object a number."""
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(1500)), "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tracemalloc.start()
    try:
        assert langid.train(df).langs == ["a", "b"]
        assert tracemalloc.get_traced_memory()[1] < 40e6
    finally:
        tracemalloc.stop()


# --- components


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components.components(Workspace(spark, "t"), spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((x, find(x)) for x in root)
