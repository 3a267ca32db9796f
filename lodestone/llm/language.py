"""Language identification in two steps: the family first, then one-versus-one linear support vector machines inside it.

Features are hashed counts of letter pairs and triples (as bytes) of the whole text.  All machines are trained in numpy on a
bounded sample of labelled texts: at most ``SAMPLE`` rows, the same number for each language, smallest hash of the id first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import blocks, pack, unpack, utf8

SAMPLE = 4000
SIZE = 4096
EPOCHS = 30
UNKNOWN = "und"

# Families of languages by code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa"),
}

_LETTER = np.full(256, 32, np.uint8)  # ASCII letters in lower case and bytes beyond ASCII; all else is a gap
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def features(texts: list[bytes]) -> np.ndarray:
    """(texts, SIZE) counts of hashed pairs and triples; no gram crosses texts."""
    data = _LETTER[np.frombuffer(b"  ".join(texts) + b"  ", np.uint8)].astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    pairs = (data[:-1] * np.uint32(0x9E3779B1) + data[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(20)
    triples = (data[:-2] * np.uint32(0xC2B2AE35) + data[1:-1] * np.uint32(0x27D4EB2F) + data[2:] * np.uint32(0x165667B1)) >> np.uint32(20)
    some = data != 32
    out = np.zeros(len(texts) * SIZE, np.float32)
    for gram, keep in ((pairs, some[:-1] | some[1:]), (triples, some[1:-1])):
        at = np.flatnonzero(keep)
        out += np.bincount(owner[at] * SIZE + gram[at], minlength=len(out)).astype(np.float32)
    return out.reshape(len(texts), SIZE)


def scaled(counts: np.ndarray) -> np.ndarray:
    x = np.log1p(counts)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def machine(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, seed: int = 3) -> np.ndarray:
    """Weights and bias of a linear support vector machine for labels of +1 and -1: averaged subgradient steps."""
    draw, n = np.random.default_rng(seed), len(x)
    w, bias, total, total_bias, seen, step = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 0, 0
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    for epoch in range(EPOCHS):
        order = draw.permutation(n)
        for lo in range(0, n, 32):
            some, step = order[lo:lo + 32], step + 1
            rate = 1 / (strength * (step + 1 / strength))
            wrong = some[y[some] * (x[some] @ w + bias) < 1]
            g = weight[wrong] * y[wrong] / len(some)
            w = (1 - rate * strength) * w + rate * (g @ x[wrong])
            bias += rate * 0.1 * g.sum()
            if epoch >= EPOCHS // 2:
                total, total_bias, seen = total + w, total_bias + bias, seen + 1
    return np.append(total, total_bias) / max(seen, 1)


class Classifier:
    """Families against the rest, and every pair of languages inside a family."""

    def __init__(self, counts: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family(g) for g in self.langs})
        x = scaled(counts)
        own, names = np.array([family(g) for g in langs]), np.array(langs)
        self.outer = np.array([machine(x, np.where(own == f, 1, -1)) for f in self.families]) if len(self.families) > 1 else None
        self.inner = {}
        for f in self.families:
            members = [g for g in self.langs if family(g) == f]
            for i, a in enumerate(members):
                for b in members[i + 1:]:
                    both = np.flatnonzero((names == a) | (names == b))
                    self.inner[a, b] = machine(x[both], np.where(names[both] == a, 1, -1))

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score per row: the family's share of the margins times the mean win over its sisters."""
        x = scaled(counts)
        n = len(x)
        share = np.ones((n, 1))
        if self.outer is not None:
            m = x @ self.outer[:, :-1].T + self.outer[:, -1]
            e = np.exp(2 * (m - m.max(axis=1, keepdims=True)))
            share = e / e.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        out, score = [""] * n, share[np.arange(n), best]
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            members = [g for g in self.langs if family(g) == f]
            votes, wins = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for i, a in enumerate(members):
                for j in range(i + 1, len(members)):
                    w = self.inner[a, members[j]]
                    m = x[rows] @ w[:-1] + w[-1]
                    p = 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
                    votes[:, i] += m >= 0
                    votes[:, j] += m < 0
                    wins[:, i] += p
                    wins[:, j] += 1 - p
            top = (votes + wins / max(1, len(members))).argmax(axis=1)
            for r, t in zip(rows.tolist(), top.tolist()):
                out[r] = members[t]
            if len(members) > 1:
                score[rows] *= wins[np.arange(len(rows)), top] / (len(members) - 1)
        return out, np.clip(score, 0.0, 1.0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = utf8(batch.column("text"))
        packed = []
        for lo, hi in blocks([len(t) + 64 for t in texts]):
            for row in features(texts[lo:hi]):
                at = np.flatnonzero(row)
                packed.append(pack(at.astype(np.uint16), row[at]))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(packed, pa.binary())], ["lang", "grams"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    """A classifier from rows (id, text, lang); None without any usable row.  Null texts and languages are left out."""
    clean = labelled.where("text is not null and lang is not null and text rlike '\\\\p{L}'")
    langs = [r[0] for r in clean.select("lang").distinct().collect()]
    if not langs:
        return None
    chosen = None
    for lang in sorted(langs):
        ids = clean.where(F.col("lang") == lang).select("id", "lang", F.xxhash64(F.lit(5), "id").alias("o")).orderBy("o", "id").limit(max(1, sample // len(langs)))
        chosen = ids if chosen is None else chosen.union(ids)
    rows = clean.join(F.broadcast(chosen.select("id", "lang").distinct()), ["id", "lang"], "left_semi")
    got = rows.orderBy("id", "text").select("lang", "text").mapInArrow(_counted, "lang string, grams binary").toArrow()
    counts = np.zeros((got.num_rows, SIZE), np.float32)
    for i, blob in enumerate(got.column("grams").to_pylist()):
        at, n = unpack(blob, "u2", "f4")
        counts[i, at] = n
    return Classifier(counts, got.column("lang").to_pylist())


def identify(docs: DataFrame, model: Classifier | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row; ``und`` with score 0 where the text is null or has no letter, or nothing was learned."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for lo, hi in blocks([len(t) + 2048 for t in texts]):
                own = texts[lo:hi]
                langs, scores = shared.value.predict(features(own)) if shared.value else ([UNKNOWN] * len(own), np.zeros(len(own)))
                for i, t in enumerate(own):
                    if not any(c.isalpha() for c in t.decode()):
                        langs[i], scores[i] = UNKNOWN, 0.0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(langs, pa.string()), pa.array(scores)], [id_column, "lang_pred", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, lang_pred string, score double")
