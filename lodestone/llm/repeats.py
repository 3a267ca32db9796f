"""Removal of byte strings that repeat from earlier documents, by sorted prefixes of content-defined cells.

Every 50-byte string has a canonical 24-byte gram: the one with the least hash, leftmost among equals.  Neighbouring strings
with the same gram occurrence form a cell (at most 27 strings, 76 bytes), so a string's gram, offset and cell are read off its
own bytes wherever it stands.  The cells are the symbols of the text.  As one symbol spans at least 50 bytes, prefixes of one
symbol decide: they are dealt out by gram, sorted, and equal neighbours begin with the same strings.  Where a gram has several
cells (the edges of repeats), the strings of one cell of each kind are compared one by one.

``suffixes.suffix_ranks`` sorts whole suffixes of such symbols by the difference-cover algorithm; at a length of 50 bytes its
recursion and merge could not change a result, and the README has the figures of running them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BLOCK_BYTES, U64, blocks, keep, pack, prefix_hash, scratch, signed, span_hash, unpack, utf8
from lodestone.session import write_table

WINDOW, GRAM = 50, 24
GRAMS = WINDOW - GRAM + 1
BUCKET_BYTES = 16 << 20  # text per bucket of grams

_BLOCKS = "block long, ids array<long>, sizes array<long>, text binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n, ids, texts = TaskContext.get().partitionId(), 0, [], []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([(part << 16) + n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
             pa.array([b"".join(texts)], pa.binary())], ["block", "ids", "sizes", "text"])

    for batch in batches:
        more_ids, more = batch.column(0).to_pylist(), utf8(batch.column(1))
        for lo, hi in blocks([len(t) for t in more]):
            if texts and sum(map(len, texts)) + sum(map(len, more[lo:hi])) > BLOCK_BYTES:
                yield out()
                n, ids, texts = n + 1, [], []
            ids, texts = ids + more_ids[lo:hi], texts + more[lo:hi]
    if ids:
        yield out()


@contextmanager
def text_blocks(docs: DataFrame) -> Iterator[tuple[DataFrame, int]]:
    """Texts of (id, text) in blocks of about a megabyte, and the number of buckets that the table is dealt to by block.

    What is found about a block meets its text bucket by bucket, without moving the text again.  The table goes at the end.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(12, -(-size // BUCKET_BYTES))
    # With fewer buckets than a shuffle has partitions, a join would deal the text out again.
    files = max(min(buckets, 4096), int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"text_blocks_{uuid.uuid4().hex}"
    docs.select("id", "text").mapInArrow(_blocks, _BLOCKS).write.option("compression", "zstd").bucketBy(files, "block").saveAsTable(name)
    try:
        yield spark.table(name).select("block", "ids", "sizes", "text"), buckets
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def cells(text: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every cell: first string start, number of strings, hash of its gram, hash of its bytes, place of its document."""
    none = np.zeros(0, np.int64)
    data = np.frombuffer(text, np.uint8)
    ends = np.cumsum(sizes)
    strings = np.maximum(sizes - WINDOW + 1, 0)
    total = int(strings.sum())
    if not total:
        return none, none, none.view(U64), none.view(U64), none
    prefix = prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = span_hash(prefix, at, at + GRAM)
    least = (gram & U64(0xFFFFFFFF00000000)) | at.astype(U64)
    wide = 1
    while wide < GRAMS:  # the least of ``wide`` grams from each start
        step = min(wide, GRAMS - wide)
        least, wide = np.minimum(least[:-step], least[step:]), wide + step
    doc = np.flatnonzero(strings)
    first = np.cumsum(strings[doc]) - strings[doc]
    start = np.arange(total) + np.repeat((ends - sizes)[doc] - first, strings[doc])
    anchor = (least[start] & U64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.diff(anchor, prepend=-1))
    n = np.diff(np.append(cut, total))
    lo = start[cut]
    owner = np.searchsorted(ends, lo, side="right")
    return lo, n, gram[anchor[cut]], span_hash(prefix, lo, lo + n + WINDOW - 1), owner


def _deal(bucket: np.ndarray, block: int, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for lo, hi in zip(cut, np.append(cut[1:], len(order))):
        own = order[lo:hi]
        yield int(bucket[own[0]]), block, pack(*(c[own] for c in columns))


_DEALT = ["bucket", "block", "data"]


def _dealt(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, d = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int64()), pa.array(d, pa.binary())], _DEALT)


def _symbols(text: bytes, ids: list[int], sizes: list[int], buckets: int):
    """Cells of a block, and its different symbols (gram and cell) with the smallest id that has each, dealt to buckets.

    Returns cells (start, number of strings, document id, symbol), the first cell of each symbol, and for each bucket the
    symbols that go there.  The order is the same whenever it is computed.
    """
    lo, n, gram, cell, owner = cells(text, np.array(sizes, np.int64))
    doc = np.array(ids, np.int64)[owner] if len(owner) else owner
    bucket = (gram % U64(buckets)).astype(np.int64)
    name = ((gram >> U64(32)) << U64(32)) | (cell >> U64(32))
    order = np.lexsort((doc, name, bucket))
    new = np.append(True, (name[order][1:] != name[order][:-1]) | (bucket[order][1:] != bucket[order][:-1]))[: len(order)]
    first = order[new]
    symbol = np.empty(len(order), np.int64)
    symbol[order] = np.cumsum(new) - 1
    cut = np.flatnonzero(np.diff(bucket[first], prepend=-1))
    dealt = [(int(bucket[first[x]]), x, y) for x, y in zip(cut, np.append(cut[1:], len(first)))] if len(first) else []
    return (lo, n, doc, symbol), first, name, gram, dealt


def _sent(buckets: int):
    """The symbols of every block, one of each: name, and the smallest id as its distance from the smallest of the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, sizes, text in zip(*(c.to_pylist() for c in batch.columns)):
                (_, _, doc, _), first, name, _, dealt = _symbols(text, ids, sizes, buckets)
                base = min(ids)
                away = (doc[first] - base).astype(U64)
                high = (away >> U64(32)).astype(np.uint32)
                yield _dealt([
                    (b, block, pack(name[first[x:y]], (away[x:y] & U64(0xFFFFFFFF)).astype(np.uint32), high[x:y] if high[x:y].any() else high[:0], np.array([base])))
                    for b, x, y in dealt])
    return run


def _told(key, rows):
    """Of a bucket: symbols are sorted, and equal neighbours begin with the same strings.

    For every block the places of symbols that a smaller id has elsewhere, and of symbols whose smallest id is here while their
    gram has other cells: only some of their strings may repeat.
    """
    parts = [unpack(d, "u8", "u4", "u4", "i8") for d in rows.column("data").to_pylist()]
    sizes = np.array([len(p[0]) for p in parts])
    name = np.concatenate([p[0] for p in parts])
    away = np.concatenate([p[1].astype(np.int64) | (p[2].astype(np.int64) << 32 if len(p[2]) else 0) for p in parts])
    doc = away + np.repeat([p[3][0] for p in parts], sizes)
    order = np.argsort(name, kind="stable")
    s, d = name[order], doc[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    run = np.diff(np.append(first, len(s)))
    least = np.minimum.reduceat(d, first)
    gram = s[first] >> U64(32)
    of_gram = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    kinds = np.diff(np.append(of_gram, len(gram)))
    several = (kinds > 1) & (np.minimum.reduceat(least, of_gram) != np.maximum.reduceat(np.maximum.reduceat(d, first), of_gram))
    several = np.repeat(np.repeat(several, kinds), run)
    repeated, wanted = np.zeros(len(s), bool), np.zeros(len(s), bool)
    repeated[order] = d > np.repeat(least, run)
    wanted[order] = several & (d == np.repeat(least, run))
    row = np.repeat(np.arange(len(parts)), sizes)
    place = (np.arange(len(s)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint32)
    some = np.flatnonzero(np.bincount(row[repeated | wanted], minlength=len(parts)))
    cuts = np.cumsum(sizes)[:-1]
    repeated, wanted, place = (np.split(x, cuts) for x in (repeated, wanted, place))
    return pa.table({
        "block": rows.column("block").to_numpy()[some], "bucket": pa.array([key[0].as_py()] * len(some), pa.int32()),
        "repeated": pa.array([place[i][repeated[i]].tobytes() for i in some], pa.binary()), "wanted": pa.array([place[i][wanted[i]].tobytes() for i in some], pa.binary())})


def _answers(told, dealt, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Which symbols of a block are repeated, and which have strings to compare."""
    start = {b: x for b, x, _ in dealt}
    repeated, wanted = np.zeros(count, bool), np.zeros(count, bool)
    for t in told or ():
        repeated[start[t["bucket"]] + np.frombuffer(t["repeated"], np.uint32)] = True
        wanted[start[t["bucket"]] + np.frombuffer(t["wanted"], np.uint32)] = True
    return repeated, wanted


def _strings(buckets: int):
    """Hashes of the strings of the wanted cells, by bucket of their gram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, sizes, text, told in zip(*(c.to_pylist() for c in batch.columns)):
                (lo, n, doc, _), first, _, gram, dealt = _symbols(text, ids, sizes, buckets)
                _, wanted = _answers(told, dealt, len(first))
                own = first[wanted]
                at, n, doc, bucket = lo[own], n[own], doc[own], (gram[own] % U64(buckets)).astype(np.int64)
                prefix = prefix_hash(np.frombuffer(text, np.uint8))
                cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                rows = []
                for k in np.split(np.arange(len(own)), cut[1:]) if len(own) else ():
                    start = np.repeat(at[k] - (np.cumsum(n[k]) - n[k]), n[k]) + np.arange(n[k].sum())
                    rows.append((int(bucket[k[0]]), block, pack(span_hash(prefix, start, start + WINDOW), n[k].astype(np.uint8), at[k].astype(np.int32), doc[k])))
                yield _dealt(rows)
    return run


def _earlier(key, rows):
    """Of a bucket: the strings that a document with a smaller id has too, as bits of their cells."""
    parts = [unpack(d, "u8", "u1", "i4", "i8") for d in rows.column("data").to_pylist()]
    hashes, n, at, doc = (np.concatenate([p[k] for p in parts]) for k in range(4))
    block = np.repeat(rows.column("block").to_numpy(), [len(p[1]) for p in parts])
    n = n.astype(np.int64)
    cell = np.repeat(np.arange(len(n)), n)
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], doc[cell[order]]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    least = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(h))))
    repeated = np.zeros(len(h), bool)
    repeated[order] = d > least
    bit = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    bits = np.add.reduceat(np.where(repeated, U64(1) << bit.astype(U64), U64(0)), np.cumsum(n) - n)
    some = np.flatnonzero(bits)
    return pa.table({"block": block[some], "at": at[some], "bits": signed(bits[some])})


_CUT = "id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(buckets: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, sizes, text, told, marks in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.frombuffer(text, np.uint8)
                edge = np.zeros(len(data) + 1, np.int32)
                (lo, n, doc, symbol), first, _, _, dealt = _symbols(text, ids, sizes, buckets)
                repeated, _ = _answers(told, dealt, len(first))
                if len(first):
                    whole = np.flatnonzero(repeated[symbol] | (doc > doc[first][symbol]))
                    np.add.at(edge, lo[whole], 1)
                    np.add.at(edge, lo[whole] + n[whole] + WINDOW - 1, -1)
                if marks:
                    # The marks of a symbol's first cell hold for every cell of it in the same document.
                    at, bits = (np.array([m[k] for m in marks], np.int64) for k in ("at", "bits"))
                    marked = np.zeros(len(first), np.int64)
                    marked[symbol[np.searchsorted(lo, at)]] = bits
                    own = np.flatnonzero((marked[symbol] != 0) & (doc == doc[first][symbol]))
                    at, n, bits = lo[own], n[own], marked[symbol[own]]
                    bit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    start = (np.repeat(at, n) + bit)[(np.repeat(bits, n) >> bit) & 1 > 0]
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + WINDOW, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out = {k: [] for k in ("n_removed", "n_spans", "kept")}
                lo = 0
                for size in sizes:
                    hi = lo + size
                    own = gone[lo:hi]
                    removed = int(np.count_nonzero(own))
                    out["n_removed"].append(removed)
                    out["n_spans"].append(int(own[0]) + int(np.count_nonzero(own[1:] & ~own[:-1])) if removed else 0)
                    kept = data[lo:hi][~own].tobytes() if removed else text[lo:hi]
                    out["kept"].append(kept if with_text else hashlib.sha256(kept).digest())
                    lo = hi
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()),
                     pa.array(out["kept"], pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])
    return run


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_text: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) per row: the bytes left when every byte is gone that a 50-byte string covers
    which also starts in a document with a smaller id.  ``kept`` is their SHA-256 digest if not ``with_text``.

    A null text is empty; texts under 50 bytes lose nothing; rows with equal ids are one document for the comparison; ids must
    not be null (such rows are left out).
    """
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).where("id is not null")
    with scratch(docs.sparkSession), text_blocks(docs) as (text, buckets):
        symbols = text.mapInArrow(_sent(buckets), "bucket int, block long, data binary")
        told = symbols.groupBy("bucket").applyInArrow(_told, "block long, bucket int, repeated binary, wanted binary")
        told = keep(told.groupBy("block").agg(F.collect_list(F.struct("bucket", "repeated", "wanted")).alias("told")), "told")
        columns = ["block", "ids", "sizes", "text", "told"]
        strings = text.join(told.hint("shuffle_hash"), "block").select(columns).mapInArrow(_strings(buckets), "bucket int, block long, data binary")
        partly = strings.groupBy("bucket").applyInArrow(_earlier, "block long, at int, bits long")
        marks = partly.groupBy("block").agg(F.collect_list(F.struct("at", "bits")).alias("marks"))
        answers = told.join(marks, "block", "left").hint("shuffle_hash")
        done = text.join(answers, "block", "left").select(*columns, "marks").mapInArrow(_cut(buckets, with_text), _CUT)
        return write_table(done, "cut", compression="zstd").withColumnRenamed("id", id_column)
