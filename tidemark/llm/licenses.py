"""License scans by a trained paragraph classifier.

A paragraph is a line that isn't blank; its features are its distinct word 1-grams and 2-grams.  A logistic
regression (softmax over licence families, `none` and `other`, an unknown licence) is trained in numpy on
variants of licence notices (words dropped, notices cut as wrapped lines are, and set among ordinary words)
against a bounded sample of the corpus's paragraphs; grams that ordinary paragraphs use are no features, and
an L1 step keeps the rest sparse.  For calibration it is first trained without some notices of each family:
those, and notices of licences that it never learns, set its temperature and the score below which a
prediction turns to `other`.

Predicted paragraphs next to each other that name no family with such a score are judged once more together,
by the sum of their features, as a notice may be wrapped.  A predicted family must be confirmed by comparison with its notices: the share of one notice's 2-grams that
the paragraph holds, together with the predicted paragraphs next to it.

Prediction is a join of grams with the sparse weights, whose size is bounded by FEATURES, and sums.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace
from .notices import NOTICES, OTHERS, UNSEEN

#: features that the model keeps at most, and paragraphs that training samples, about
FEATURES, SAMPLE = 4096, 4000
CONFIRM = 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASSES = ("none", "other", *NOTICES)
PATTERN = r"[^a-z0-9\x80-\x{10FFFF}]+"


def paragraph_words(text: str) -> list[str]:
    """What paragraphs() splits a line into, in Python."""
    lowered = text.translate({ord(a): b for a, b in zip(UPPER, LOWER)})
    return [w for w in re.split("[^a-z0-9\x80-\U0010ffff]+", lowered) if w]


def grams(words: list[str]) -> list[str]:
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))})


def template(notice: str) -> set[str]:
    """The 2-grams of a notice."""
    words = paragraph_words(notice)
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


@dataclass
class Model:
    features: list[str]
    weights: np.ndarray  # features x classes
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, paragraphs: list[str]) -> np.ndarray:
        """The same scores in numpy; for calibration and tests."""
        at = {f: i for i, f in enumerate(self.features)}
        x = np.zeros((len(paragraphs), len(at)))
        for i, p in enumerate(paragraphs):
            x[i, [at[g] for g in grams(paragraph_words(p)) if g in at]] = 1
        return softmax((x @ self.weights + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _variants(notices: list[tuple[str, int]], ordinary: list[str], rng: np.random.Generator) -> list[tuple[str, int]]:
    """(paragraph, class) from (notice, class): notices with words dropped and cut, bare and among ordinary words."""
    filler = [w for p in ordinary for w in p.split()] or ["the", "of", "and", "a", "text", "in", "to"]

    def some(n: int) -> list[str]:
        at = int(rng.integers(0, max(1, len(filler) - n)))
        return filler[at : at + n]

    out = []
    for notice, k in notices:
        for _ in range(12 if "{}" in notice else 24):
            words = notice.format(*(w.title() for w in (some(3) + ["x", "y"]))).split()
            if len(words) > 20 and rng.random() < 0.5:  # a line of it, as it is wrapped
                at = int(rng.integers(0, len(words) - 9))
                words = words[at : at + int(rng.integers(9, 16))]
            if rng.random() < 0.4 and len(words) > 6:
                words = [w for w in words if rng.random() > 0.1]
            if rng.random() < 0.4:
                words = [*some(int(rng.integers(0, 12))), *words, *some(int(rng.integers(0, 12)))]
            out.append((" ".join(words), k))
    out += [(p, 0) for p in ordinary]
    for _ in range(400):
        out.append((" ".join(some(int(rng.integers(1, 40)))), 0))
    return out


def _learn(rows: list[tuple[str, int]], ordinary: list[str], rng: np.random.Generator, epochs: int) -> Model:
    """Weights of (paragraph, class) rows, not yet calibrated."""
    rows = [rows[i] for i in rng.permutation(len(rows))]
    count: dict[str, int] = {}
    bags = [grams(paragraph_words(p)) for p, _ in rows]
    for bag, (_, y) in zip(bags, rows):
        for g in bag if y else ():
            count[g] = count.get(g, 0) + 1
    usual: dict[str, int] = {}
    for p in ordinary:
        for g in grams(paragraph_words(p)):
            usual[g] = usual.get(g, 0) + 1
    count = {g: n for g, n in count.items() if n > 1 and usual.get(g, 0) <= max(1, len(ordinary) // 500)}
    features = sorted(sorted(count, key=lambda g: (-count[g], g))[:FEATURES])
    at = {g: i for i, g in enumerate(features)}
    y = np.array([c for _, c in rows])
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, bag in enumerate(bags):
        x[i, [at[g] for g in bag if g in at]] = 1
    weights, bias = np.zeros((len(features), len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32)
    for epoch in range(epochs):
        step = 0.5 / (1 + epoch / 10)
        for index in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            p = softmax(x[index] @ weights + bias)
            p[np.arange(len(index)), y[index]] -= 1
            weights -= step * (x[index].T @ p) / len(index) * 4
            bias -= step * p.mean(0)
            weights = np.sign(weights) * np.maximum(np.abs(weights) - step * 2e-4, 0)
    used = np.flatnonzero(np.abs(weights).sum(1) > 0)
    return Model([features[i] for i in used], weights[used].astype(float), bias.astype(float), 1.0, 0.0)


def fit(ordinary: list[str], seed: int = 1, epochs: int = 40) -> Model:
    """Trains on variants of the notices against ordinary paragraphs (those that resemble a notice go)."""
    rng = np.random.default_rng(seed)
    known = [set(grams(paragraph_words(n))) for n in (*(n for ns in NOTICES.values() for n in ns), *OTHERS, *UNSEEN)]
    bags = [set(grams(paragraph_words(p))) for p in ordinary]
    ordinary = [p for p, bag in zip(ordinary, bags) if not any(len(k & bag) >= 0.4 * len(k) for k in known)]
    notices = [(n, k, i) for k, family in enumerate(CLASSES) for i, n in enumerate(NOTICES.get(family, OTHERS if family == "other" else ()))]
    # without every third notice of each class, and every fifth ordinary paragraph
    model = _learn(_variants([(n, k) for n, k, i in notices if i % 3 != 2], [p for i, p in enumerate(ordinary) if i % 5], rng), ordinary, rng, epochs)
    held = _variants([(n, k) for n, k, i in notices if i % 3 == 2] + [(n, 1) for n in UNSEEN], ordinary[::5], rng)
    y, texts = np.array([k for _, k in held]), [p for p, _ in held]
    temperature = min(np.geomspace(0.2, 5, 40), key=lambda t: -np.log(replace(model, temperature=t).probabilities(texts)[np.arange(len(y)), y] + 1e-12).mean())
    p = replace(model, temperature=temperature).probabilities(texts)
    best, score = p.argmax(1), p.max(1)
    # a family named rightly counts for, one named wrongly against a bound
    gain = lambda t: ((best > 1) & (best == y) & (score >= t)).sum() - ((best > 1) & (best != y) & (score >= t)).sum()
    threshold = max(np.linspace(0.2, 0.95, 76), key=lambda t: (gain(t), -t))
    whole = _learn(_variants([(n, k) for n, k, _ in notices], ordinary, rng), ordinary, rng, epochs)
    return replace(whole, temperature=float(temperature), threshold=float(threshold))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Ordinary paragraphs are about `sample` of all paragraphs of docs, whole, drawn by a hash of doc_id and line number."""
    lines = docs.where("text is not null").select("doc_id", F.split("text", "\n").alias("lines"))
    n = lines.agg(F.sum(F.size("lines"))).first()[0] or 0
    part = F.pmod(F.xxhash64(F.lit(29), "doc_id", "at"), F.lit(1 << 30))
    rows = lines.select("doc_id", F.posexplode("lines").alias("at", "p")).select(part.alias("part"), "p").where(F.col("part") < int(min(1.0, sample / max(1, n)) * (1 << 30)))
    return fit([r["p"] for r in sorted(rows.collect(), key=lambda r: (r["part"], r["p"])) if r["p"].strip()])


def scan(ws: Workspace, docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> rid, doc_id, n_paragraphs, par, family, score, overlap, confirmed: one row with
    par -1 per document, and one per paragraph (line with words) that is predicted to be of a licence family
    or of an unknown licence (family other; never confirmed)."""
    spark = docs.sparkSession

    def inline(rows: list, schema: str) -> DataFrame:
        return spark.sql(f"select inline(from_json(:rows, 'array<struct<{schema}>>'))", args={"rows": json.dumps(rows)})

    grams_ = F.array_distinct(F.concat("words", F.expr("zip_with(slice(words, 1, size(words) - 1), slice(words, 2, greatest(size(words) - 1, 1)), (a, b) -> concat(a, ' ', b))")))
    grams_ = F.when(F.size("words") > 1, grams_).otherwise(F.array_distinct("words"))
    lines = F.coalesce(F.split("text", "\n"), F.expr("cast(array() as array<string>)"))
    number = F.size(F.filter(lines, lambda p: p.rlike(r"[A-Za-z0-9\x80-\x{10FFFF}]"))).cast("long")
    docs = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), number.alias("n_paragraphs"), lines.alias("lines"))
    docs = docs.select("rid", "doc_id", "n_paragraphs", F.posexplode(F.concat(F.array(F.lit("")), "lines")).alias("par", "line"))
    words = F.array_remove(F.split(F.translate("line", UPPER, LOWER), PATTERN), "")
    spread = docs.select("rid", "doc_id", "n_paragraphs", (F.col("par") - 1).alias("par"), words.alias("words"))
    spread = spread.select("rid", "doc_id", "n_paragraphs", "par", "words", F.explode(F.when(F.col("par") < 0, F.array(F.lit(""))).otherwise(grams_)).alias("gram"))
    weights = inline([{"gram": f, "w": [float(x) for x in w]} for f, w in zip(model.features, model.weights)], "gram:string,w:array<double>")
    notices = [{"gram": g, "family": k, "notice": i, "size": len(two)} for k, ns in NOTICES.items() for i, n in enumerate(ns) for two in [template(n)] for g in two]
    notices = inline(notices, "gram:string,family:string,notice:int,size:int")

    # at most FEATURES rows
    hit = spread.join(F.broadcast(weights), "gram", "left").where("w is not null or par < 0")
    logits = [F.sum(F.get("w", F.lit(i))).alias(f"l{i}") for i in range(len(CLASSES))]
    hit = hit.groupBy("rid", "doc_id", "n_paragraphs", "par").agg(*logits, F.first("words").alias("words"))

    def judged(df: DataFrame) -> DataFrame:
        """With best and score of the sums l0, l1, ..."""
        z = [(F.col(f"l{i}") + float(model.bias[i])) / model.temperature for i in range(len(CLASSES))]
        top = F.greatest(*z)
        best: Column = F.lit(CLASSES[-1])
        for i in reversed(range(len(CLASSES) - 1)):
            best = F.when(z[i] == top, CLASSES[i]).otherwise(best)
        total = sum((F.exp(v - top) for v in z[1:]), F.exp(z[0] - top))
        return df.withColumns({"best": best, "score": 1 / total})

    sums = [f"l{i}" for i in range(len(CLASSES))]
    hit = judged(hit).where("best <> 'none' or par < 0")
    hit = ws.keep(hit.withColumn("family", F.when(F.col("score") < model.threshold, "other").otherwise(F.col("best"))))
    # predicted paragraphs in a row form a run; those of no sure family are judged together
    lines = hit.where("par >= 0").withColumn("run", F.col("par") - F.row_number().over(Window.partitionBy("rid").orderBy("par")))
    lines = ws.keep(lines.select("rid", "run", "par", "family", "words", *sums))
    together = judged(lines.where("family = 'other'").groupBy("rid", "run").agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("n")).where("n > 1"))
    together = together.where(~F.col("best").isin("none", "other") & (F.col("score") >= model.threshold)).select("rid", "run", F.lit("other").alias("family"), F.col("best").alias("r_family"), F.col("score").alias("r_score"))
    lines = lines.drop(*sums).join(together, ["rid", "run", "family"], "left").withColumn("family", F.coalesce("r_family", "family"))
    two = F.expr("zip_with(slice(words, 1, greatest(size(words) - 1, 0)), slice(words, 2, greatest(size(words) - 1, 0)), (a, b) -> concat(a, ' ', b))")
    held = lines.select("rid", "run", F.explode(two).alias("gram")).distinct()
    # some two thousand rows of notices
    shares = held.join(F.broadcast(notices), "gram").groupBy("rid", "run", "family", "notice").agg((F.count("*") / F.first("size")).alias("share"))
    shares = shares.groupBy("rid", "run", "family").agg(F.max("share").alias("overlap"))
    shares = lines.select("rid", "run", "par", "family", "r_family", "r_score").join(shares, ["rid", "run", "family"], "left").select("rid", "par", "r_family", "r_score", "overlap")
    out = hit.drop("words", "best", *sums).join(shares, ["rid", "par"], "left")
    out = out.withColumns({"family": F.coalesce("r_family", "family"), "score": F.coalesce("r_score", "score")})
    overlap = F.coalesce("overlap", F.lit(0.0))
    return out.select("rid", "doc_id", "n_paragraphs", "par", "family", F.round("score", 6).alias("score"), F.round(overlap, 6).alias("overlap"), (overlap >= CONFIRM).alias("confirmed"))


def license_scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per row: doc_id, n_paragraphs (lines with words), n_license (those
    predicted as a licence), license (confirmed families, sorted, joined by commas; `unknown` if paragraphs are
    predicted but none is confirmed; else null), score (the highest of a confirmed paragraph, else null).

    Null, empty and blank texts have no paragraph.  Repeated rows are judged each; a null doc_id stays null;
    other columns are ignored.  Without a model, one is trained on docs.
    """
    ws = Workspace(docs.sparkSession, "licenses")
    model = model or train(docs)
    found = ws.keep(scan(ws, docs.select("doc_id", "text"), model))
    confirmed = F.col("confirmed") & (F.col("par") >= 0)
    families = F.array_sort(F.collect_set(F.when(confirmed, F.col("family"))))
    out = found.groupBy("rid", "doc_id", "n_paragraphs").agg(F.count_if(F.col("par") >= 0).alias("n_license"), families.alias("families"), F.max(F.when(confirmed, F.col("score"))).alias("score"))
    license_ = F.when(F.size("families") > 0, F.concat_ws(",", "families")).when(F.col("n_license") > 0, "unknown")
    return out.select("doc_id", "n_paragraphs", "n_license", license_.alias("license"), "score")
