"""Token counts of whole texts by overlap resynchronisation.

A boundary is proven where a single space stands between two visible characters: every pattern of the
byte-level pre-tokeniser ends a match before that space (only a match's first character may be a space) and
starts one with it (all its patterns for visible characters take one leading space), whatever stands further
to either side; the only look-ahead is for white space, and special strings that hold no space can't cross
it.  So the tokens left of a proven boundary depend on the left alone, those right of it on the right alone.

A huge text is encoded in overlapping chunks with offsets, and two neighbours are spliced at the first proven
boundary inside their overlap at which both have a token start.  If an overlap holds none, it is widened
until it does or reaches the end of the text.  Shorter texts fall into pieces at the same boundaries; the
counts of pieces that come again are remembered, within a bound, and new pieces are encoded together.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

CHUNK = 16_384
OVERLAP = 256
#: texts of one call, and pieces remembered by one worker at most (some 150 MB)
SLICE = 64
PIECES = 1_000_000
#: neither white space nor control characters in any reading of Unicode
_SEEN = r"[^\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]"
BOUNDARY = re.compile(rf"(?<={_SEEN}) (?={_SEEN})")
WHOLE = re.compile(rf"{_SEEN}(?:.*{_SEEN})?", re.DOTALL)


def splices(spec: dict) -> bool:
    """Whether a tokenizer's description is one whose splices are proven: byte-level pre-tokeniser with its own
    pattern and no prefix space, no normaliser, and no special string that holds or takes spaces."""
    pre = spec.get("pre_tokenizer") or {}
    return (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space", True)
        and pre.get("use_regex", True)
        and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", ()))
    )


class Counter:
    """Counts tokens with the library that a vocabulary file is for."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.chunk, self.overlap = chunk, overlap
        self.known: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model, self.proven = sentencepiece.SentencePieceProcessor(model_file=path), False
            self.batch = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            self.model = model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            with open(path, encoding="utf-8") as file:
                self.proven = splices(json.load(file))
            encode = getattr(model, "encode_batch_fast", model.encode_batch)
            self.batch = lambda texts: [len(x) for x in encode(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.proven:
            return self.batch(texts)
        known = self.known
        if len(known) > PIECES:
            known.clear()
        # a piece is counted with the space before it, but for the first of a text
        pieces = [t.split(" ") if len(t) <= self.chunk else [] for t in texts]
        self.learn([w for w in {w: None for p in pieces for w in p[1:]} if w not in known])
        edges = [bool(p) and not WHOLE.fullmatch(p[0]) for p in pieces]
        first = self.batch([p[0] if p else "" for p in pieces])
        out = []
        for text, p, odd, n in zip(texts, pieces, edges, first):
            if not p:
                out.append(self.long(text))
                continue
            numbers = [known[w] for w in p[1:]]
            if numbers and (odd or min(numbers) < 0):  # not every space is a proven boundary
                p = BOUNDARY.split(text)
                n = self.batch([p[0]])[0]
                again = [x for x in {w: None for w in p[1:]} if known.get(x, -1) < 0]
                odds = dict(zip(again, self.batch([" " + x for x in again])))
                numbers = [odds[x] if x in odds else known[x] for x in p[1:]]
            out.append(n + sum(numbers))
        return out

    def learn(self, fresh: list[str]) -> None:
        """Counts of new pieces, each with a space before it; -1 for those at whose ends no boundary is proven."""
        self.known.update(dict.fromkeys(fresh, -1))
        fresh = [w for w in fresh if WHOLE.fullmatch(w)]
        for at in range(0, len(fresh), 2000):
            part = fresh[at : at + 2000]
            ends = np.cumsum([len(w) + 1 for w in part])
            starts = np.array(self._starts(" " + " ".join(part), 0, int(ends[-1])))
            self.known.update(zip(part, np.bincount(np.searchsorted(ends, starts, "right"), minlength=len(part)).tolist()))

    def _starts(self, text: str, at: int, end: int) -> list[int]:
        """Starts of the tokens of text[at:end] as positions in text."""
        return [at + a for a, _ in self.model.encode(text[at:end], add_special_tokens=False).offsets]

    def long(self, text: str) -> int:
        total, at = 0, 0
        while at + self.chunk + self.overlap < len(text):
            cut, overlap = at + self.chunk, self.overlap
            while True:
                end = min(cut + overlap, len(text))
                left = self._starts(text, at, end)
                if end == len(text):
                    return total + len(left)
                splice = self.splice(text, cut, end, left, self._starts(text, cut, end + overlap))
                if splice:
                    break
                overlap *= 4
            total += sum(x < splice for x in left)
            at = splice
        return total + len(self._starts(text, at, len(text)))

    @staticmethod
    def splice(text: str, cut: int, end: int, left: list[int], right: list[int]) -> int:
        """The first proven boundary in text[cut:end] that both encodings have, or 0."""
        both = set(left) & set(right)
        return next((m.start() for m in BOUNDARY.finditer(text, cut, end) if m.start() in both), 0)


@lru_cache(maxsize=4)
def counter(path: str, chunk: int, overlap: int) -> Counter:
    return Counter(path, chunk, overlap)


def token_counts(docs: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    path: a vocabulary file that every executor can read, .json for tokenizers and .model for sentencepiece.
    A null text counts as an empty one; both have no bytes and no tokens.  Rows that repeat are counted
    each; a null doc_id stays null; other columns are ignored.
    """

    def f(batch: pa.RecordBatch):
        count = counter(path, chunk, overlap)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        numbers: list[int] = []
        for at in range(0, len(texts), SLICE):
            numbers += count.counts(texts[at : at + SLICE])
        yield {"doc_id": batch.column(0), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": numbers, "over_limit": [n > limit for n in numbers]}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", f)
