"""Packing of token sequences as a cutting-stock problem solved by column generation.

Documents are cut into whole sequences of 1024 tokens and one rest.  Rests are counted by length in classes of four tokens: a
histogram of at most 256 numbers, the only thing the driver sees.  A linear program over patterns (how many rests of each class
share a sequence) is solved by column generation, an unbounded-knapsack dynamic program pricing new patterns; its solution is
rounded down, and what is left over is packed largest first.  Rests are ranked inside their class by a distributed count, and a
rank decides the pattern copy, and so the sequence, that a rest goes to.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import keep, utf8

LENGTH = 1024
UNIT = 4
END = 0

_ENCODERS: dict[str, tuple] = {}


def _byte_of() -> dict[str, int]:
    """Symbols that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + k)] = b
    return out


def encoder(path: str):
    """A function from text to ids for a byte-level vocabulary file of the ``tokenizers`` library.

    Ids of such a file are merge ranks, so ``tiktoken`` gives the same ids several times faster; a text on which its pattern
    engine gives up, or that holds the name of a token added to the vocabulary, goes to ``tokenizers``.
    """
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        special, names = {t["id"] for t in added}, tuple(t["content"] for t in added)
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special}
        fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _ENCODERS[path] = (fast, slow, names)
    fast, slow, names = _ENCODERS[path]

    def encode(text: str) -> list[int]:
        if any(name in text for name in names):
            return slow.encode(text, add_special_tokens=False).ids
        try:
            return fast.encode_ordinary(text)
        except Exception:  # noqa: BLE001  its pattern engine limits its steps
            return slow.encode(text, add_special_tokens=False).ids
    return encode


def _tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, n, whole = encoder(path), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            out = {"row": [], "tokens": [], "wholes": [], "crcs": []}
            for text in utf8(batch.column(1)):
                ids = np.array([*encode(text.decode()), END], "<u4")
                out["row"].append(n)
                out["tokens"].append(len(ids))
                out["wholes"].append(whole)
                out["crcs"].append([zlib.crc32(ids[i:i + LENGTH].tobytes()) for i in range(0, len(ids), LENGTH)])
                n, whole = n + 1, whole + len(ids) // LENGTH
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * batch.num_rows, pa.int32()), pa.array(out["row"], pa.int64()), pa.array(out["tokens"], pa.int64()),
                 pa.array(out["wholes"], pa.int64()), pa.array(out["crcs"], pa.list_(pa.int64()))], ["id", "part", "row", "tokens", "wholes", "crcs"])
    return run


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: an unbounded knapsack by dynamic programming over the filled units."""
    order = np.argsort(sizes, kind="stable")
    small, worth = sizes[order], values[order]
    fits = np.searchsorted(small, np.arange(capacity + 1), side="right")
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        best[w], n = best[w - 1], fits[w]
        if n:
            total = best[w - small[:n]] + worth[:n]
            j = total.argmax()
            if total[j] > best[w] + 1e-12:
                best[w], last[w] = total[j], order[j]
    pattern, w = np.zeros(len(sizes), np.int64), capacity
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            pattern[last[w]] += 1
            w -= sizes[last[w]]
    return float(best[capacity]), pattern


def cutting_stock(sizes: np.ndarray, counts: np.ndarray, capacity: int, tolerance: float = 1e-3) -> list[tuple[int, np.ndarray]]:
    """(copies, pattern) pairs that hold every item: the rounded linear program, then the rest largest first.

    ``sizes`` and ``capacity`` in units.  Column generation ends when no pattern is worth more than ``1 + tolerance``
    sequences, which bounds the distance to the optimum of the linear program by that share.
    """
    m = len(sizes)
    if not m:
        return []
    fit = capacity // sizes
    inverse, columns = np.diag(1.0 / fit), [np.where(np.arange(m) == i, fit, 0) for i in range(m)]
    level = counts / fit + 1e-9 * np.arange(1, m + 1)  # the small shift keeps degenerate steps from cycling
    while True:
        duals = inverse.sum(axis=0)
        value, pattern = price(np.maximum(duals, 0), sizes, capacity)
        if value <= 1 + tolerance:
            break
        direction = inverse @ pattern
        up = direction > 1e-10
        ratio = np.full(m, np.inf)
        ratio[up] = level[up] / direction[up]
        out = int(ratio.argmin())
        step = ratio[out]
        level = level - step * direction
        level[out] = step
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        columns[out] = pattern
    left, plan = counts.astype(np.int64).copy(), []
    for pattern, x in zip(columns, level):
        used = pattern > 0
        copies = min(int(np.floor(x + 1e-6)), int((left[used] // pattern[used]).min()))
        if copies > 0:
            plan.append((copies, pattern.astype(np.int64)))
            left -= copies * pattern
    order = np.argsort(-sizes, kind="stable")
    while left.any():
        room, pattern = capacity, np.zeros(m, np.int64)
        for i in order:
            k = min(room // sizes[i], left[i])
            pattern[i], room = k, room - k * sizes[i]
        used = pattern > 0
        copies = int((left[used] // pattern[used]).min())
        plan.append((copies, pattern))
        left -= copies * pattern
    return plan


def _assign(plan: list[tuple[int, np.ndarray]], sizes: np.ndarray):
    """Rank inside a class -> sequence and slot, by tables whose size depends on the patterns only."""
    base, at, entries = 0, dict.fromkeys(sizes.tolist(), 0), {int(s): [] for s in sizes}
    for copies, pattern in plan:
        slot = 0
        for i in np.flatnonzero(pattern)[::-1]:
            size, a = int(sizes[i]), int(pattern[i])
            entries[size].append((at[size], base, a, slot))
            at[size] += copies * a
            slot += a
        base += copies
    tables = {s: np.array(e, np.int64).reshape(-1, 4) for s, e in entries.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = batch.column("kind").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(kind):
                own, t = kind == s, tables[int(s)]
                row = t[np.searchsorted(t[:, 0], rank[own], side="right") - 1]
                beyond = rank[own] - row[:, 0]
                sequence[own], slot[own] = row[:, 1] + beyond // row[:, 2], row[:, 3] + beyond % row[:, 2]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "start", "length", "crc", "tokens")), pa.array(sequence), pa.array(slot)],
                ["id", "start", "length", "crc", "tokens", "sequence_id", "slot"])
    return run, base


def packed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """One row per piece of a document: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A null text is empty and has the end id only.  Rows with equal or null ids are documents of their own.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, part int, row long, tokens long, wholes long, crcs array<long>"
    tokens = keep(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(_tokens(path), schema), "tokens")

    rests = tokens.where(F.col("tokens") % LENGTH > 0).withColumn("kind", F.ceil(F.col("tokens") % LENGTH / UNIT).cast("long"))
    counts = rests.groupBy("kind", "part").count()
    histogram = {r[0]: r[1] for r in counts.groupBy("kind").agg(F.sum("count")).collect()}  # at most LENGTH / UNIT rows
    sizes = np.array(sorted(histogram), np.int64)
    plan = cutting_stock(sizes, np.array([histogram[s] for s in sizes.tolist()], np.float64), LENGTH // UNIT)
    assign, used = _assign(plan, sizes)

    earlier = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("kind", "part").orderBy("row")) - 1
    ranked = rests.withColumn("local", local).join(offsets.select("kind", "part", "before"), ["kind", "part"])
    rest = F.col("tokens") % LENGTH
    placed = ranked.select(
        "id", (F.col("tokens") - rest).alias("start"), rest.alias("length"), F.element_at("crcs", -1).alias("crc"), "tokens", "kind",
        (F.col("before") + F.col("local")).alias("rank"),
    ).mapInArrow(assign, f"id {kind}, start long, length long, crc long, tokens long, sequence_id long, slot long")
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))

    cut = tokens.where(F.col("tokens") >= LENGTH)
    totals = tokens.groupBy("part").agg(F.sum(F.floor(F.col("tokens") / LENGTH)).alias("n"))
    # One row per task of the tokenizing step.
    parts = totals.withColumn("first", used + F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = cut.join(parts.select("part", "first"), "part").select(
        "id", "tokens", (F.col("first") + F.col("wholes")).alias("first"), F.posexplode(F.slice("crcs", F.lit(1), F.floor(F.col("tokens") / LENGTH).cast("int"))).alias("k", "crc"))
    whole = whole.select(
        "id", (F.col("k").cast("long") * LENGTH).alias("start"), F.lit(LENGTH).cast("long").alias("length"), "crc", "tokens",
        (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rows = placed.select("id", "start", "length", "crc", "tokens", "sequence_id", "offset").union(whole)
    return rows.select(
        F.col("id").alias(id_column), "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), "sequence_id", "offset")
