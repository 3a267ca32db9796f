"""Toxicity by a convolutional text classifier trained in numpy.

A word is the sum of three rows of one hashed embedding table: the word's own, and those of its first four and six bytes, so
that unseen inflections of a known stem are near it; filters of one, two and three words run over the sequence,
each filter keeps its maximum over the whole text, and a linear layer weighs the maxima.  Training reads all labelled texts,
dealt into shards by the hash of their ids: in every epoch each shard goes on from the common model, and what the shards learned is
averaged, a word's row over the shards that met it.  Scoring reads every whole text.
Thresholds are calibrated for each language, told apart by its common function words in the text itself, and the score is
moved so that 0.5 is the language's threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodestone.llm.common import U64, blocks, keep, let_go, pack, prefix_hash, release_memory, scratch, span_hash, unpack, utf8

SHARD_TEXTS, SHARD_BYTES = 4096, 1 << 25  # about what one shard holds
ROWS, SIZE, WIDTHS, FILTERS = 1 << 17, 16, (1, 2, 3), 16
STEMS = (4, 6)
EPOCHS, BATCH, RATE = 8, 32, 0.1
SLICE = 8192
BINS, REACH = 256, 32  # logits of the thresholds are counted in steps of 1 / BINS between -REACH and REACH
CHUNK = 2048  # rows of the table that are averaged together
PAD = ROWS  # the embedding of nothing stays zero

# Common function words.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "are"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "von", "zu", "mit", "den", "auf", "ein"),
    "fr": ("le", "les", "des", "et", "est", "dans", "une", "pour", "pas", "sur", "qui", "du"),
    "es": ("el", "los", "del", "las", "por", "con", "una", "para", "como", "su", "al", "lo"),
}
LANGUAGES = (*FUNCTION_WORDS, "")

_PART = np.ones(256, bool)  # bytes of words: letters, digits and everything beyond ASCII
_PART[:128] = False
for _r in (range(48, 58), range(65, 91), range(97, 123)):
    _PART[list(_r)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per word the hashes of itself and its stems; the words before each text."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    edge = np.flatnonzero(np.diff(_PART[data].view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    prefix = prefix_hash(data)
    hashes = [span_hash(prefix, starts, ends), *(span_hash(prefix, starts, np.minimum(ends, starts + n)) for n in STEMS)]
    return np.stack(hashes, axis=1), np.searchsorted(starts, bounds)


def _markers() -> tuple[np.ndarray, np.ndarray]:
    hashes, _ = _hashes([" ".join(w).encode() for w in FUNCTION_WORDS.values()])
    kinds = np.repeat(np.arange(len(FUNCTION_WORDS)), [len(w) for w in FUNCTION_WORDS.values()])
    order = np.argsort(hashes[:, 0])
    return hashes[order, 0], kinds[order]


def languages(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Index into ``LANGUAGES`` per text: the language with most function words, the last entry without any."""
    known, kinds = _markers()
    hashes = hashes[:, 0]
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = np.flatnonzero(known[at] == hashes)
    text = np.searchsorted(before, hit, side="right") - 1
    counts = np.zeros((len(before) - 1, len(LANGUAGES)))
    np.add.at(counts, (text, kinds[at[hit]]), 1)
    counts[:, -1] = 0.5
    return counts.argmax(axis=1)


def rows_of(hashes: np.ndarray) -> np.ndarray:
    """The embedding rows of each word: each kind of hash picks its own."""
    salts = np.arange(hashes.shape[1], dtype=U64) * U64(0x9E3779B97F4A7C15)
    return (((hashes ^ salts) * U64(0xD6E8FEB86659FD93)) >> U64(47)).astype(np.int32)


@dataclass
class Model:
    table: np.ndarray  # (ROWS + 1, SIZE)
    kernels: list[np.ndarray]  # by width: (width, SIZE, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray  # one number
    thresholds: np.ndarray  # by language, on the logit

    def responses(self, words: np.ndarray) -> np.ndarray:
        """(n, 48) filter responses at each start; words beyond the end are nothing."""
        n = len(words)
        x = np.zeros((n + max(WIDTHS) - 1, SIZE), np.float32)
        x[:n] = self.table[words[:, 0]]
        for k in range(1, words.shape[1]):
            x[:n] += self.table[words[:, k]]
        out = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        for i, kernel in enumerate(self.kernels):
            r = x[:n] @ kernel[0]
            for o in range(1, len(kernel)):
                r += x[o:n + o] @ kernel[o]
            out[:, i * FILTERS:(i + 1) * FILTERS] = r
        return out

    def logits(self, rows: np.ndarray, before: np.ndarray) -> np.ndarray:
        """One logit per text.  Texts are laid out with gaps of nothing, then convolved slice by slice."""
        texts, gap = len(before) - 1, max(WIDTHS) - 1
        owner = np.repeat(np.arange(texts), np.diff(before))
        words = np.full((len(rows) + gap * texts, rows.shape[1]), PAD, np.int32)
        words[np.arange(len(rows)) + gap * owner] = rows
        first = before[:-1] + gap * np.arange(texts)
        pooled = np.full((texts, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        for lo in range(0, len(words), SLICE):
            hi = min(lo + SLICE, len(words))
            r = self.responses(words[lo:hi + gap])[: hi - lo]
            r[words[lo:hi, 0] == PAD] = -np.inf
            i, j = np.searchsorted(first, lo, side="right") - 1, np.searchsorted(first, hi)
            cuts = np.maximum(first[i:j] - lo, 0)
            some = np.diff(np.append(cuts, hi - lo)) > 0
            part = np.maximum.reduceat(r, cuts[some], axis=0)
            pooled[i:j][some] = np.maximum(pooled[i:j][some], part)
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        hashes, before = _hashes(texts)
        z = self.logits(rows_of(hashes), before).astype(np.float64) - self.thresholds[languages(hashes, before)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Learner:
    """A model with its Adagrad sums."""

    model: Model
    seen_table: np.ndarray
    seen: list[np.ndarray]  # of the dense arrays

    def dense(self) -> list[np.ndarray]:
        return [*self.model.kernels, self.model.bias, self.model.out, self.model.out_bias]

    def copy(self) -> Learner:
        m = self.model
        return Learner(
            Model(m.table.copy(), [k.copy() for k in m.kernels], m.bias.copy(), m.out.copy(), m.out_bias.copy(), m.thresholds.copy()),
            self.seen_table.copy(), [a.copy() for a in self.seen])


def beginner(seed: int = 7) -> Learner:
    draw = np.random.default_rng(seed)
    table = (draw.standard_normal((ROWS + 1, SIZE)) * 0.1).astype(np.float32)
    table[PAD] = 0
    kernels = [(draw.standard_normal((w, SIZE, FILTERS)) * (0.5 / np.sqrt(w))).astype(np.float32) for w in WIDTHS]
    n_out = len(WIDTHS) * FILTERS
    out = (draw.standard_normal(n_out) * 0.2).astype(np.float32)
    model = Model(table, kernels, np.zeros(n_out, np.float32), out, np.zeros(1, np.float32), np.zeros(len(LANGUAGES)))
    seen = [*(np.full_like(k, 1e-6) for k in kernels), *(np.full(n, 1e-6, np.float32) for n in (n_out, n_out, 1))]
    return Learner(model, np.full(ROWS + 1, 1e-6, np.float32), seen)


def train(learner: Learner, words: list[np.ndarray], labels: np.ndarray, share: float, draw: np.random.Generator) -> None:
    """One epoch of Adagrad on the log loss; the gradient reaches the words at which a filter had its maximum."""
    model, table, kernels, n_out = learner.model, learner.model.table, learner.model.kernels, len(WIDTHS) * FILTERS
    seen_table, (*seen_kernels, seen_bias, seen_out, seen_one) = learner.seen_table, learner.seen
    usable = np.array([i for i, w in enumerate(words) if len(w)], np.int64)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    draw.shuffle(usable)
    for lo in range(0, len(usable), BATCH):
        some = usable[lo:lo + BATCH]
        at, top, picked = np.zeros((len(some), n_out), np.int64), np.zeros((len(some), n_out), np.float32), []
        for b, i in enumerate(some):
            r = model.responses(words[i])
            at[b] = r.argmax(axis=0)
            top[b] = r[at[b], np.arange(n_out)]
            padded = np.vstack([words[i], np.full((max(WIDTHS) - 1, words[i].shape[1]), PAD, np.int32)])
            picked.append(padded[at[b][:, None] + np.arange(max(WIDTHS))])
        picked = np.stack(picked)  # (b, filter, offset, row)
        hidden = np.maximum(top + model.bias, 0)
        z = hidden @ model.out + model.out_bias
        g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) * weight[some] / len(some)).astype(np.float32)
        g_out = g @ hidden
        g_hidden = g[:, None] * model.out * (hidden > 0)
        x = table[picked].sum(axis=3)
        touched, pushed = [], []
        for k, (kernel, width) in enumerate(zip(kernels, WIDTHS)):
            span = slice(k * FILTERS, (k + 1) * FILTERS)
            for o in range(width):
                grad = np.einsum("bf,bfs->sf", g_hidden[:, span], x[:, span, o])
                touched.append(picked[:, span, o].reshape(-1, picked.shape[3]))
                pushed.append(np.einsum("bf,sf->bfs", g_hidden[:, span], kernel[o]).reshape(-1, SIZE))
                seen_kernels[k][o] += grad * grad
                kernel[o] -= RATE * grad / np.sqrt(seen_kernels[k][o])
        rows, push = np.concatenate(touched), np.concatenate(pushed)
        rows, push = rows.T.ravel(), np.concatenate([push] * rows.shape[1])
        row, inverse = np.unique(rows, return_inverse=True)
        total = np.zeros((len(row), SIZE), np.float32)
        np.add.at(total, inverse, push)
        seen_table[row] += (total * total).mean(axis=1)
        table[row] -= RATE * total / np.sqrt(seen_table[row])[:, None]
        table[PAD] = 0
        seen_out += g_out * g_out
        model.out -= (RATE * g_out / np.sqrt(seen_out)).astype(np.float32)
        g_bias = g_hidden.sum(axis=0)
        seen_bias += g_bias * g_bias
        model.bias -= (RATE * g_bias / np.sqrt(seen_bias)).astype(np.float32)
        seen_one += float(g.sum()) ** 2
        model.out_bias -= RATE * float(g.sum()) / np.sqrt(seen_one)


def calibrate(logits: np.ndarray, labels: np.ndarray, counts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The threshold of each language with the best F1 on texts kept out of training; all texts' where a language has few.

    A row stands for as many texts as its count says.
    """
    def best(z, y, w):
        order = np.argsort(-z, kind="stable")
        z, y, w = z[order], y[order], w[order]
        last = np.flatnonzero(np.append(z[1:] != z[:-1], True))  # equal logits fall on one side
        hit, taken = np.cumsum(w * y)[last], np.cumsum(w)[last]
        f1 = 2 * hit / (taken + (w * y).sum())
        i = int(f1.argmax())
        z = z[last]
        below = z[i + 1] if i + 1 < len(z) else z[i] - 1
        return (z[i] + below) / 2

    if not len(logits) or not labels.any():
        return np.zeros(len(LANGUAGES))
    out = np.full(len(LANGUAGES), best(logits, labels, counts))
    for k in range(len(LANGUAGES)):
        own = kinds == k
        if (labels[own] * counts[own]).sum() >= 20:
            out[k] = best(logits[own], labels[own], counts[own])
    return out


def _packed(key: tuple, rows: pa.Table) -> pa.Table:
    """The texts of a shard as one value: labels, parts, languages, words before each text, rows of its different words, word numbers."""
    rows = rows.sort_by([("id", "ascending"), ("text", "ascending")])
    texts = utf8(rows.column("text"))
    hashed = [_hashes(texts[lo:hi]) for lo, hi in blocks([len(t) for t in texts])]
    hashes = np.concatenate([h for h, _ in hashed])
    before = np.append(0, np.cumsum(np.concatenate([np.diff(b) for _, b in hashed])))
    _, one, number = np.unique(hashes[:, 0], return_index=True, return_inverse=True)
    blob = pack(
        rows.column("label").to_numpy().astype(np.uint8), rows.column("part").to_numpy().astype(np.uint8), languages(hashes, before).astype(np.uint8),
        before.astype(np.int64), rows_of(hashes[one]).ravel(), number.astype(np.uint32))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "texts": pa.array([blob], pa.binary())})


def _texts(blob: bytes, part: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Labels, languages and words of the texts of a shard that are in the part."""
    labels, parts, kinds, before, rows, number = unpack(blob, "u1", "u1", "u1", "i8", "i4", "u4")
    rows, own = rows.reshape(-1, 1 + len(STEMS)), np.flatnonzero(parts == part)
    return labels[own].astype(np.float32), kinds[own], [rows[number[before[i]:before[i + 1]]] for i in own]


def _flat(learner: Learner) -> np.ndarray:
    return np.concatenate([a.ravel() for a in (*learner.dense(), *learner.seen)]).astype(np.float64)


def _learn(learner: Learner, shards: DataFrame, share: float, seed: int, epoch: int) -> Learner:
    """The learner after an epoch over all shards: the mean of what they learned, of a word's row over the shards that met it."""
    spark = shards.sparkSession
    shared = spark.sparkContext.broadcast(learner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        moved, met = np.zeros((ROWS + 1, SIZE + 1)), np.zeros(ROWS + 1)
        dense, count = np.zeros(len(_flat(base))), 0
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                labels, _, words = _texts(blob.as_py(), 0)
                own = base.copy()
                train(own, words, labels, share, np.random.default_rng([seed, epoch, shard]))
                row = np.flatnonzero(own.seen_table != base.seen_table)
                moved[row, :SIZE] += own.model.table[row].astype(np.float64) - base.model.table[row]
                moved[row, SIZE] += own.seen_table[row].astype(np.float64) - base.seen_table[row]
                met[row] += 1
                dense += _flat(own) - _flat(base)
                count += 1
        if count:
            parts = [pack(moved[lo:lo + CHUNK].astype(np.float32), met[lo:lo + CHUNK].astype(np.float32)) for lo in range(0, ROWS + 1, CHUNK)]
            parts.append(pack(dense.astype(np.float32), np.array([count], np.float32)))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "moved"])

    def mean(key: tuple, rows: pa.Table) -> pa.Table:
        both = [unpack(blob.as_py(), "f4", "f4") for blob in rows.column("moved")]
        total, n = sum(b[0].astype(np.float64) for b in both), sum(b[1].astype(np.float64) for b in both)
        out = (total.reshape(len(n), -1) / np.maximum(n, 1)[:, None]).astype(np.float32)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "moved": pa.array([out.tobytes()], pa.binary())})

    tasks = spark.sparkContext.defaultParallelism  # each sends as much as the model holds, however many shards it goes through
    got = shards.coalesce(tasks).mapInArrow(run, "chunk int, moved binary").groupBy("chunk").applyInArrow(mean, "chunk int, moved binary").toArrow()
    after = learner.copy()
    last = -(-(ROWS + 1) // CHUNK)
    for chunk, blob in zip(got.column("chunk").to_pylist(), got.column("moved")):
        values = np.frombuffer(blob.as_py(), np.float32)
        if chunk < last:
            rows = values.reshape(-1, SIZE + 1)
            after.model.table[chunk * CHUNK:(chunk + 1) * CHUNK] += rows[:, :SIZE]
            after.seen_table[chunk * CHUNK:(chunk + 1) * CHUNK] += rows[:, SIZE]
        else:
            at = 0
            for a in (*after.dense(), *after.seen):
                a += values[at:at + a.size].reshape(a.shape)
                at += a.size
    after.model.table[PAD] = 0
    shared.destroy()
    let_go(spark)
    return after


def _thresholds(model: Model, shards: DataFrame) -> np.ndarray:
    """Thresholds from all texts kept out of training: their logits are counted in narrow steps."""
    shared = shards.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(1):
                labels, kinds, words = _texts(blob.as_py(), 1)
                z = np.array([shared.value.logits(w, np.array([0, len(w)]))[0] for w in words], np.float64)
                step = np.floor(np.clip(z, -REACH, REACH) * BINS).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds.astype(np.int32)), pa.array(labels.astype(np.int32)), pa.array(step)], ["kind", "label", "step"])

    got = shards.mapInArrow(run, "kind int, label int, step int").groupBy("kind", "label", "step").count().toArrow()
    kind, label, step, count = (c.to_numpy() for c in got.columns)
    shared.destroy()
    order = np.lexsort((step, label, kind))
    return calibrate((step[order] + 0.5) / BINS, label[order], count[order].astype(np.float64), kind[order])


def fit(labels: DataFrame, docs: DataFrame, shard_texts: int = SHARD_TEXTS, seed: int = 7) -> Model:
    """A model from all labels (id, label 0/1) of texts (id, text).

    Null labels and texts and labels without a text are left out.  A fifth of the texts, by hash of the id, is kept out of training for
    the thresholds.  The shards depend on the ids and the number and size of the texts alone, not on how the tables are cut.
    """
    spark = docs.sparkSession
    clean = labels.where("label in (0, 1)").select("id", F.col("label").cast("int").alias("label")).distinct()
    part = (F.pmod(F.xxhash64(F.lit(13), F.col("id")), F.lit(5)) == 0).cast("int")
    joined = docs.where("text is not null").select("id", "text").join(clean, "id").select("id", "text", "label", part.alias("part"))
    with scratch(spark):
        seen = Observation()
        learned = F.col("part") == 0
        texts = keep(joined.observe(
            seen, F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.count_if(learned).alias("learned"),
            F.count_if(learned & (F.col("label") == 1)).alias("toxic")), "labelled", compression="zstd")
        let_go(spark)  # the join's shuffle, before the texts are dealt into shards
        n, size, most, toxic = (seen.get[k] or 0 for k in ("n", "bytes", "learned", "toxic"))
        learner = beginner(seed)
        if n:
            shard = F.pmod(F.xxhash64(F.lit(11), F.col("id")), F.lit(max(-(-n // shard_texts), -(-size // SHARD_BYTES))))
            shards = keep(texts.withColumn("shard", shard).groupBy("shard").applyInArrow(_packed, "shard long, texts binary"), "shards", compression="zstd")
            share = min(max(toxic / max(1, most), 0.01), 0.99)
            for epoch in range(EPOCHS):
                learner = _learn(learner, shards, share, seed, epoch)
            learner.model.thresholds = _thresholds(learner.model, shards)
    release_memory()
    return learner.model


def score(docs: DataFrame, model: Model, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, score and predicted per row; a null or empty text has no words and gets the score of an empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(len(keep)))
            for lo, hi in blocks([len(t) for t in texts]):
                s = shared.value.scores(texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(lo, hi - lo) for k in range(len(keep))), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                    [*keep, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    columns = [F.col(c) for c in keep] + [F.col(text_column).alias("_text")]
    return docs.select(*columns).mapInArrow(run, f"{kinds}, score double, predicted int")
