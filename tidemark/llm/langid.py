"""Language identification by averaged hashed subword embeddings and a linear softmax, with rejection.

A text's features are the byte 2-, 3- and 4-grams of its lower-cased words with their boundaries, hashed
into BUCKETS rows of an embedding table; their mean goes through a linear softmax.  Table and softmax are
trained together by stochastic gradient descent in numpy, on a bounded sample of labelled rows.  A held-out
part of the sample sets the temperature of the softmax and the score below which a text is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import arrow_map, unused

BUCKETS, WIDTH = 1 << 13, 16
#: rows of each language that training sees at most
PER_LANG = 400
#: share of right answers of the calibration rows that rejection may cost
REJECT = 0.001
GRAMS = (2, 3, 4)
_WORD = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))
_LETTER = bytes(int(i >= 128 or chr(i).isalpha()) for i in range(256))


def _grams(run: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Lower-cased texts -> (bucket of each gram by its start, valid flag) for each size, and text bounds."""
    data = b"  ".join(run) + b"     "
    raw = np.frombuffer(data.translate(_WORD), np.uint8).astype(np.uint32)
    letter = np.frombuffer(data.translate(_LETTER), bool)
    n = len(raw) - 4
    bounds = np.zeros(len(run) + 1, np.int64)
    np.cumsum([len(x) + 2 for x in run], out=bounds[1:])
    bounds[-1] = n
    buckets, valid = [], []
    for size in GRAMS:
        h = raw[:n] * np.uint32(size)
        for j in range(size):
            h = (h ^ raw[j : n + j]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        buckets.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(19)).astype(np.intp))
        if size == 2:
            ok = letter[:n] | letter[1 : n + 1]
        else:
            ok = letter[1 : n + 1].copy()
            for j in range(2, size - 1):
                ok &= letter[j : n + j]
        valid.append(ok)
    return buckets, valid, bounds


def histogram(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of one text."""
    buckets, valid, _ = _grams([b" " + text.lower().encode("utf-8", "surrogatepass")])
    counts = np.bincount(np.concatenate([b[v] for b, v in zip(buckets, valid)]), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / max(1, counts.sum())).astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # languages x BUCKETS: embedding times weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)))
        for first, run in kernels.passes([" " + t.lower() for t in texts]):
            buckets, valid, bounds = _grams(run)
            number = sum(np.add.reduceat(v, bounds[:-1], dtype=np.int64) for v in valid)
            for k in range(len(self.langs)):
                row = self.table[k]
                total = sum(np.add.reduceat(np.where(v, row[b], 0), bounds[:-1], dtype=np.float64) for b, v in zip(buckets, valid))
                out[first : first + len(run), k] = total / np.maximum(number, 1) + self.bias[k]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Best language and calibrated score; und and 0 for a null text and one without letters."""
        some = [i for i, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if some:
            p = softmax(self.logits([texts[i] for i in some]) / self.temperature)
            best = p.argmax(1)
            scores[some] = np.round(p.max(1), 6)
            for i, k in zip(some, best.tolist()):
                langs[i] = self.langs[k]
        return langs, scores


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray, bool]], epochs: int = 25, rate: float = 1.0, seed: int = 1) -> Model:
    """rows: (language, buckets, shares, for calibration)."""
    langs = sorted({r[0] for r in rows})
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = np.zeros((WIDTH, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    weights[:] = rng.normal(0, 0.3, weights.shape)
    y = np.array([langs.index(r[0]) for r in rows], int)
    train = np.array([i for i, r in enumerate(rows) if not r[3]], int)
    held = np.array([i for i, r in enumerate(rows) if r[3]], int)
    if not len(train) or not len(held):
        train = held = np.arange(len(rows))

    def dense(index: np.ndarray) -> np.ndarray:
        x = np.zeros((len(index), BUCKETS), np.float32)
        for k, i in enumerate(index):
            x[k, rows[i][1]] = rows[i][2]
        return x

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(train)
        for at in range(0, len(order), 32):
            index = order[at : at + 32]
            x = dense(index)
            mean = x @ table
            p = softmax(mean @ weights + bias)
            p[np.arange(len(index)), y[index]] -= 1
            p = (p / len(index)).astype(np.float32)
            up = p @ weights.T
            weights -= step * (mean.T @ p)
            bias -= step * 0.1 * p.sum(0)
            # each bucket has few of the grams of a text: its step is longer
            table -= step * 50 * (x.T @ up)
    logits = np.concatenate([dense(held[i : i + 256]) @ table @ weights + bias for i in range(0, len(held), 256)]).astype(float) if len(rows) else np.zeros((0, 0))
    best, threshold = 1.0, 0.0
    if len(langs) > 1:
        at = np.arange(len(held)), y[held]
        best = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(softmax(logits / t)[at] + 1e-12).mean())
        p = softmax(logits / best)
        right = np.sort(p.max(1)[p.argmax(1) == y[held]])
        threshold = min(0.5, float(right[int(REJECT * len(right))])) if len(right) else 0.0
    return Model(langs, np.ascontiguousarray((table @ weights).T), bias.astype(float), float(best), threshold)


def _features(batch: pa.RecordBatch):
    """(lang, part, text) -> features of the whole text and of two short pieces of it, as the bytes of their arrays:
    lists would be a Python object a number on the driver."""
    langs, parts, texts = (c.to_pylist() for c in batch.columns)
    out = {"lang": [], "part": [], "buckets": [], "shares": []}
    for lang, part, text in zip(langs, parts, texts):
        words = text.split()
        for piece in (text, *(" ".join(words[a : a + n]) for a, n in ((part % max(1, len(words)), 4), (part // 7 % max(1, len(words)), 9)))):
            if any(map(str.isalpha, piece)):
                buckets, shares = histogram(piece)
                for k, v in zip(out, (lang, part, buckets.tobytes(), shares.tobytes())):
                    out[k].append(v)
    yield out


def train(labelled: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Trains on at most about per_lang rows of each language of labelled (doc_id, text, lang), drawn by a hash
    of doc_id, the same in every run.  Rows with a null text, lang or doc_id are left out."""
    labelled = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0), 1.0, 0.0)
    draw = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30))
    # a third above the bound, so that chance seldom leaves fewer; the rest go by their hash below
    share = None
    for lang, n in sorted(counts.items()):
        this = F.lit(int(min(1.0, 1.3 * per_lang / n) * (1 << 30)))
        share = F.when(F.col("lang") == lang, this) if share is None else share.when(F.col("lang") == lang, this)
    sample = labelled.where(draw < share).select("lang", draw.alias("part"), "text")
    rows = arrow_map(sample, "lang string, part long, buckets binary, shares binary", _features).collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["part"], len(r["buckets"])))
    kept, seen = [], {}
    for r in rows:
        parts = seen.setdefault(r["lang"], set())
        if r["part"] in parts or len(parts) < per_lang:
            parts.add(r["part"])
            kept.append((r["lang"], np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32), r["part"] % 5 == 0))
    return fit(kept)


def predict(docs: DataFrame, model: Model, *extra: str | Column) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, the extra columns, lang_pred, score, rejected: one row per row.

    A null text and one without a letter give und, score 0 and rejected.  Empty tables give empty results;
    repeated rows are predicted each; a null doc_id stays null.  Extra columns named doc_id or like a result
    give way to it."""

    def f(batch: pa.RecordBatch):
        langs, scores = model.predict(batch.column(0).to_pylist())
        yield dict(zip(batch.schema.names[1:], batch.columns[1:])) | {"lang_pred": langs, "score": scores, "rejected": [lang == "und" or s < model.threshold for lang, s in zip(langs, scores.tolist())]}

    wanted = docs.select(*extra).columns if extra else []
    kept = [c for c, n in zip(extra, wanted) if n.lower() not in ("doc_id", "lang_pred", "score", "rejected")]
    docs = docs.select("text", "doc_id", *kept).toDF(*unused(docs.select(*kept), "text_"), "doc_id", *docs.select(*kept).columns)
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes[1:]) + ", lang_pred string, score double, rejected boolean"
    return arrow_map(docs, schema, f)


def held_out() -> Column:
    """Whether a row is held out of training: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
