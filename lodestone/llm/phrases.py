"""Phrase collocations from an FM-index per shard over word ids.

Documents are cut into shards of one language each.  A shard's text is the sequence of its word ids with a separator at every
end of a piece; it is indexed forwards and backwards by suffixes ordered to the depth of the longest phrase, of which the
index keeps only the two Burrows-Wheeler columns and the counts of the words.  Phrases are enumerated by bidirectional interval
extension: every word's interval is extended to the right through the backward index, and each longer phrase to the left through
the forward index, all intervals of a length at once.

Counts are summed across shards: first those of words, so that words under the least count (which no phrase can hold) end a
piece; then those of the phrases, packed by hash bucket, so that a phrase is one entry per shard and no bucket is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import U64, keep, mix, scratch
from lodestone.session import write_table

SHARD = 1_000_000  # words of a shard; bounds a worker's memory
BUCKET = 2_000_000  # words of the corpus for each hash bucket of phrases
DEPTH = 3
_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: between words, 2: between pieces
_KIND[[32, 9]] = 1
_KIND[[ord(c) for c in ".,;:!?"]] = 2
_KIND[10:14] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_ZSTD = pa.Codec("zstd", compression_level=1)


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one value, each compressed by byte planes."""
    out = [len(arrays[0]).to_bytes(8, "little")]
    for a in arrays:
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T) if len(a) else np.zeros(0, np.uint8)
        body = _ZSTD.compress(planes.tobytes(), asbytes=True)
        out += [len(body).to_bytes(8, "little"), body]
    return b"".join(out)


def unsqueezed(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for kind in map(np.dtype, kinds):
        size = int.from_bytes(blob[at:at + 8], "little")
        raw = _ZSTD.decompress(blob[at + 8:at + 8 + size], n * kind.itemsize, asbytes=True)
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel())
        at += 8 + size
    return out


def tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and for each the number of pieces that ended before it."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    kind = _KIND[data]
    inside = kind == 0
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    piece = np.cumsum(kind == 2)[starts] if len(starts) else np.zeros(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    letters = np.ascontiguousarray(data[inside])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)]), piece


def _sequence(words: list[pa.Array], pieces: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words, and the shard's ids (word + 1) with 0 before, between and after pieces."""
    coded = pa.chunked_array(words, pa.large_binary()).combine_chunks()
    if isinstance(coded, pa.ChunkedArray):
        coded = pa.concat_arrays(coded.chunks) if coded.num_chunks else pa.array([], pa.large_binary())
    coded = coded.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    piece = np.concatenate(pieces)
    at = np.arange(len(ids)) + 1 + np.concatenate(([0], np.cumsum(piece[1:] != piece[:-1]))) if len(ids) else np.zeros(0, np.int64)
    text = np.zeros(int(at[-1]) + 2 if len(at) else 1, np.int64)
    text[at] = ids
    return coded.dictionary, text


def bwt(text: np.ndarray, depth: int) -> np.ndarray:
    """The word before each suffix, suffixes ordered by their first ``depth`` words."""
    bits = int(text.max(initial=0)).bit_length() or 1
    if bits * depth <= 63:
        key = text << bits * (depth - 1)
        for k in range(1, depth):
            key[:-k] |= text[k:] << bits * (depth - 1 - k)
        order = np.argsort(key)
    else:
        order = np.lexsort([np.concatenate((text[k:], np.zeros(k, np.int64))) for k in range(depth - 1, -1, -1)])
    order -= 1
    return text[order]


class Index:
    """Both columns of a shard with their word counts; intervals are (first, size) in forward and backward order."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray, wanted: np.ndarray):
        self.columns = (forward, backward)
        counts = np.bincount(forward, minlength=len(wanted))
        self.first = np.concatenate(([0], np.cumsum(counts)))[:-1]
        self.counts = counts
        self.wanted = wanted  # by symbol; 0 is never wanted

    def singles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of wanted words with their forward and backward intervals."""
        symbol = np.flatnonzero(self.wanted & (self.counts > 0))
        return symbol, self.first[symbol], self.first[symbol], self.counts[symbol]

    def extended(self, side: int, first: np.ndarray, other: np.ndarray, size: np.ndarray):
        """Every interval extended by each wanted word that stands next to it: to the left by the forward column (side 0), to
        the right by the backward one (side 1).  ``first`` belongs to that column, ``other`` to its counterpart.

        Returns the interval extended, the word, the start of the longer phrase in the counterpart, and its count.
        """
        ends = np.cumsum(size)
        n = int(ends[-1]) if len(ends) else 0
        span = len(self.wanted)
        at = np.arange(n)
        at += np.repeat(first - ends + size, size)
        pair = np.repeat(np.arange(len(size)) * span, size)
        pair += self.columns[side][at]
        del at
        pair.sort()
        new = np.flatnonzero(np.concatenate((np.ones(min(n, 1), bool), pair[1:] != pair[:-1])))
        count = np.diff(new, append=n)
        owner, word = pair[new] // span, pair[new] % span
        # In the counterpart the longer phrases lie inside the interval in the order of the words.
        start = other[owner] + new - (ends - size)[owner]
        own = np.flatnonzero(self.wanted[word])
        return owner[own], word[own], start[own], count[own]

    def grams(self) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray]]:
        """Phrases of two and of three wanted words as columns of symbols, with counts."""
        symbol, forward, backward, size = self.singles()
        owner, after, start, count = self.extended(1, backward, forward, size)
        first, second = symbol[owner], after
        yield (first, second), count
        owner, before, _, longer = self.extended(0, start, np.zeros(len(start), np.int64), count)
        yield (before, first[owner], second[owner]), longer


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (lang, text) to shards: distinct words, their counts, and both columns."""
    part, made = TaskContext.get().partitionId(), 0
    waiting: dict[str, tuple[list, list, list]] = {}

    def flushed(lang: str) -> pa.RecordBatch:
        nonlocal made
        words, pieces, _ = waiting.pop(lang)
        distinct, text = _sequence(words, pieces)
        made += 1
        counts = np.bincount(text, minlength=len(distinct) + 1)[1:]
        body = squeezed(bwt(text, DEPTH).astype(np.uint32), bwt(text[::-1], DEPTH).astype(np.uint32))
        return pa.RecordBatch.from_arrays(
            [pa.array([part << 24 | made], pa.int64()), pa.array([lang]), pa.array([distinct.cast(pa.large_string()).to_pylist()], pa.list_(pa.string())),
             pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([body], pa.binary())], ["shard", "lang", "words", "counts", "body"])

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        for lang in dict.fromkeys(langs):
            own, size = [], 0
            for text in [t for l, t in zip(langs, texts) if l == lang] + [None]:
                if text is not None:
                    own.append(text)
                    size += len(text)
                if own and (text is None or size > 1 << 20):
                    words, piece = tokens(own)
                    w, p, n = waiting.setdefault(lang, ([], [], [0, 0]))
                    w.append(words)
                    p.append(piece + n[1])
                    n[0] += len(words)
                    n[1] += int(piece[-1]) + 1 if len(piece) else 0
                    own, size = [], 0
                    if n[0] >= SHARD:
                        yield flushed(lang)
    for lang in list(waiting):
        yield flushed(lang)


def _packed_keys(columns: tuple[np.ndarray, ...], bits: int) -> list[np.ndarray]:
    """Columns of ids below 2^bits as few 63-bit keys as hold them."""
    per = max(1, 63 // bits)
    keys = []
    for lo in range(0, len(columns), per):
        key = columns[lo].astype(np.int64)
        for c in columns[lo + 1:lo + per]:
            key = key << bits | c
        keys.append(key)
    return keys


def _unpacked(keys: list[np.ndarray], length: int, bits: int) -> list[np.ndarray]:
    per, out = max(1, 63 // bits), []
    for i, lo in enumerate(range(0, length, per)):
        n = min(per, length - lo)
        out += [keys[i] >> bits * (n - 1 - j) & (1 << bits) - 1 for j in range(n)]
    return out


def _enumerated(bits: int, buckets: int):
    """A shard's phrases in global ids, packed by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, found in zip(batch.column("body"), batch.column("ids")):
                forward, backward = unsqueezed(body.as_py(), "<u4", "<u4")
                known = found.values
                place, ids = known.field("place").to_numpy() + 1, known.field("id").to_numpy()
                size = int(max(forward.max(initial=0), place.max(initial=0))) + 1
                to = np.full(size, -1, np.int64)
                to[place] = ids
                index = Index(forward.astype(np.int64), backward.astype(np.int64), to >= 0)
                for columns, count in index.grams():
                    keys = _packed_keys(tuple(to[c] for c in columns), bits)
                    with np.errstate(over="ignore"):
                        h = np.zeros(len(count), U64)
                        for k in keys:
                            h = mix(h * U64(0x9E3779B97F4A7C15) + k.view(U64) + U64(1))
                    bucket = (h % U64(buckets)).astype(np.int64)
                    order = np.lexsort((keys[0], bucket))
                    bucket = bucket[order]
                    edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(bucket)), bool), bucket[1:] != bucket[:-1])))
                    keys, count = [k[order] for k in keys], count[order]
                    ends = np.append(edge[1:], len(bucket))
                    blobs = [
                        squeezed(count[a:b].astype(np.uint32), np.diff(keys[0][a:b], prepend=0), *(k[a:b] for k in keys[1:]))
                        for a, b in zip(edge.tolist(), ends.tolist())]
                    for lo in range(0, len(blobs), 256):
                        some = blobs[lo:lo + 256]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(bucket[edge[lo:lo + 256]], pa.int32()), pa.array(np.full(len(some), len(columns), np.int32)), pa.array(some, pa.binary())],
                            ["bucket", "length", "body"])
    return run


def _summed(bits: int, least: int):
    """The phrases of a bucket with their counts over all shards, from ``least`` up."""
    def run(key, rows):
        length = key[1].as_py()
        kinds = ["<u4"] + ["<i8"] * -(-length // max(1, 63 // bits))
        parts = [unsqueezed(b, *kinds) for b in rows.column("body").to_pylist()]
        count = np.concatenate([p[0] for p in parts]).astype(np.int64)
        keys = [np.concatenate([np.cumsum(p[i]) if i == 1 else p[i] for p in parts]) for i in range(1, len(kinds))]
        order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
        keys = [k[order] for k in keys]
        new = np.zeros(len(order), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        at = np.flatnonzero(new)
        total = np.add.reduceat(count[order], at)
        own = np.flatnonzero(total >= least)
        ids = _unpacked([k[at[own]] for k in keys], length, bits)
        none = pa.nulls(len(own), pa.int64())
        return pa.table({"w1": pa.array(ids[0]), "w2": pa.array(ids[1]), "w3": pa.array(ids[2]) if length > 2 else none, "a": pa.array(total[own])})
    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n))], [*batch.schema.names, "part", "row"])
        row += n


def _vocabulary(shards: DataFrame, least: int) -> DataFrame:
    """(lang, word, n, id): words that occur ``least`` times, numbered from 0."""
    words = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))
    rows = keep(words.where(F.col("n") >= least).mapInArrow(_numbered, "lang string, word string, n long, part int, row long"), "vocabulary")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    parts = rows.groupBy("part").agg(F.count("*").alias("size")).select("part", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("before"))
    return keep(rows.join(parts, "part").select("lang", "word", "n", (F.col("before") + F.col("row")).alias("id")), "words")


def grams(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (lang, text): occurrences of all words per language; the words and the phrases that occur ``least`` times."""
    shards = keep(docs.mapInArrow(_shards, "shard long, lang string, words array<string>, counts array<long>, body binary"), "shards")
    totals = keep(shards.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n_all")), "totals")
    vocabulary = _vocabulary(shards, least)
    size, words = vocabulary.count(), totals.agg(F.coalesce(F.sum("n_all"), F.lit(0))).first()[0]
    bits = max(1, size.bit_length())
    local = shards.select("shard", "lang", F.posexplode("words").alias("place", "word"))
    known = local.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("place", "id")).alias("ids"))
    packed = shards.select("shard", "body").join(known, "shard").select("body", "ids").mapInArrow(
        _enumerated(bits, max(1, -(-words // BUCKET))), "bucket int, length int, body binary")
    counted = packed.groupBy("bucket", "length").applyInArrow(_summed(bits, least), "w1 long, w2 long, w3 long, a long")
    return totals, vocabulary, keep(counted, "grams")


def _scored(docs: DataFrame, least: int, percent: int) -> DataFrame:
    totals, vocabulary, found = grams(docs, least)
    # What one removal of an end word leaves: the shorter phrases that a longer one holds.
    longer = found.where("w3 is not null")
    inner = longer.select(F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a")
    held = inner.groupBy("p.w1", "p.w2").agg(F.max("a").alias("most"))
    pairs = found.where("w3 is null").select("w1", "w2", "a").join(held, ["w1", "w2"], "left")
    pairs = pairs.where(F.coalesce(F.lit(100) * F.col("most") < F.lit(percent) * F.col("a"), F.lit(True)))

    def words(*names: str) -> DataFrame:
        return vocabulary.select(F.col("id").alias(names[0]), F.col("word").alias(names[1]), F.col("n").alias(names[2]), *([F.col("lang")] if len(names) > 3 else []))

    part = found.where("w3 is null").select("w1", "w2", "a")
    two = pairs.select("w1", "w2", F.lit(None).cast("long").alias("w3"), "a", F.lit(None).cast("long").alias("head"), F.lit(None).cast("long").alias("tail"))
    three = longer.join(part.select("w1", "w2", F.col("a").alias("head")), ["w1", "w2"]).join(
        part.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("tail")), ["w2", "w3"]).select("w1", "w2", "w3", "a", "head", "tail")
    rows = two.union(three).join(words("w1", "t1", "n1", "lang"), "w1").join(words("w2", "t2", "n2"), "w2").join(words("w3", "t3", "n3"), "w3", "left")

    def score(left: str, right: str):
        big = {c: F.col(c).cast("decimal(19,0)") for c in ("a", left, right)}
        over = (big["a"] * big["a"]).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
        return F.call_function("div", over.cast("decimal(38,0)"), (big[left] * big[right]).cast("decimal(38,0)"))

    short = F.col("w3").isNull()
    one, other = score("n1", "tail"), score("head", "n3")
    early = one <= other
    rows = rows.select(
        "lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a",
        F.when(short | early, F.col("n1")).otherwise(F.col("head")).alias("l"),
        F.when(short, F.col("n2")).when(early, F.col("tail")).otherwise(F.col("n3")).alias("r"),
        F.when(short, score("n1", "n2")).when(early, one).otherwise(other).cast("long").alias("score"))
    return rows.join(totals, "lang").select("lang", "phrase", "a", "l", "r", F.col("n_all").alias("n"), "score")


def collocations(df: DataFrame, text_column: str = "text", group_column: str = "lang", least: int = 10, percent: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two or three words of each language.

    Null texts are empty, a null language is ``und``; equal scores go by count and then by phrase in byte order, so ranks are unique.
    A table without such phrases gives no rows.  Repeated rows count as often as they stand there; extra columns are ignored.
    """
    docs = df.select(F.coalesce(F.col(group_column), F.lit("und")).alias("lang"), F.col(text_column).alias("text"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    with scratch(df.sparkSession):
        scored = keep(_scored(docs, least, percent), "scored")
        # The best of each share first, so that no task orders all phrases of a language.
        share = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
        best = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        return write_table(best.select(F.col("lang").alias(group_column), "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
