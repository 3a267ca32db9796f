"""Near-duplicate lines by a segment-partition edit join.

Equal lines are one class.  A line is split into ``edits + 1`` segments of almost equal length; a line within the edit distance
must contain one of them unchanged, at a place that the lengths of both lines confine.  Segments are indexed by line length and
segment number, substrings of a line are probed at the confined places only, and both meet by hash.  Candidates pass a sketch of
character pairs (an edit changes the parity of four counts at most) and are verified by a banded bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import U64, char_prefix, char_span, components, keep, mix, scratch, signed, unpack
from lodestone.llm.repeats import _deal, _dealt, text_blocks
from lodestone.session import write_table

EDITS = 2
LEAST = 16  # characters; shorter lines are equal or different
BUCKET_SHARE = 2  # key buckets per bucket of text
_NEWLINE = 10


def _characters(text: bytes, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a block, line starts and ends, and the document of each line; no line crosses documents."""
    data = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    raw = np.frombuffer(text, np.uint8)
    before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters before each byte
    bounds = before[np.concatenate(([0], np.cumsum(sizes)))]
    breaks = np.flatnonzero(data == _NEWLINE)
    starts = np.concatenate((bounds[:-1], breaks + 1))
    ends = np.concatenate((breaks, bounds[1:]))
    starts.sort()
    # A document's end closes its last line; an empty document has one empty line.
    ends.sort()
    lines = np.bincount(np.searchsorted(bounds[1:], breaks, side="right"), minlength=len(sizes)) + 1
    owner = np.repeat(np.arange(len(sizes)), lines)
    return data, starts, ends, owner


def segments(length: np.ndarray, edits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number, first character and size of every segment of lines of the given lengths; later segments are the longer ones."""
    size, more = np.divmod(length, edits + 1)
    for i in range(edits + 1):
        long = np.maximum(0, i - (edits + 1 - more))
        yield i, i * size + long, size + (i >= edits + 1 - more)


def probes(length: np.ndarray, edits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For lines of the given lengths against indexed lines shorter by ``gap``: gap, segment, start, size, whether it applies.

    With segment i equal, at most i edits fall before it and ``edits - i`` after it, which confines its start from both sides.
    """
    for gap in range(edits + 1):
        for i, first, size in segments(length - gap, edits):
            low, high = max(-i, gap - (edits - i)), min(i, gap + (edits - i))
            for shift in range(low, high + 1):
                start = first + shift
                yield gap, i, start, size, (start >= 0) & (start + size <= length) & (size > 0)


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, ids, sizes, text in zip(*(c.to_pylist() for c in batch.columns)):
            data, starts, ends, owner = _characters(text, sizes)
            prefix = char_prefix(data)
            first = np.searchsorted(owner, np.arange(len(sizes)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(char_span(prefix, starts, ends))), pa.array((ends - starts).astype(np.int32)), pa.array(np.array(ids, np.int64)[owner]),
                 pa.array((np.arange(len(starts)) - first[owner]).astype(np.int32)), pa.array(np.full(len(starts), block)), pa.array(starts.astype(np.int32))],
                ["line", "size", "doc", "number", "block", "at"])


def _sketches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Parities of 64 classes of neighbouring characters; lines have two characters at least."""
    if len(data) < 2:
        return np.zeros(len(starts), U64)
    bit = U64(1) << (mix(data[:-1].astype(U64) << U64(32) | data[1:].astype(U64)) & U64(63))
    running = np.concatenate((np.zeros(1, U64), np.bitwise_xor.accumulate(bit)))
    return running[ends - 1] ^ running[starts]


def _keys(buckets: int, edits: int):
    """Index and probe keys of the different lines of each block, by bucket of the key; the lowest bit tells which they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, sizes, text in zip(*(c.to_pylist() for c in batch.columns)):
                data, starts, ends, _ = _characters(text, sizes)
                prefix = char_prefix(data)
                line = char_span(prefix, starts, ends)
                keep = np.flatnonzero(ends - starts >= LEAST)
                keep = keep[np.unique(line[keep], return_index=True)[1]]
                starts, length, line = starts[keep], (ends - starts)[keep], line[keep]
                sketch = _sketches(data, starts, starts + length)
                keys, owners = [], []

                def add(role, at, size, indexed, i, own):
                    h = char_span(prefix, at, at + size)
                    h = mix(h + indexed.astype(U64) * U64(0xD6E8FEB86659FD93) + U64((i + 1) * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF))
                    keys.append(h & ~U64(1) | U64(role))
                    owners.append(own)

                everyone = np.arange(len(line))
                for i, first, size in segments(length, edits):
                    add(0, starts + first, size, length, i, everyone)
                for gap, i, start, size, applies in probes(length, edits):
                    own = np.flatnonzero(applies & (length - gap >= LEAST))
                    add(1, starts[own] + start[own], size[own], length[own] - gap, i, own)
                key, own = np.concatenate(keys), np.concatenate(owners)
                short = ((key >> U64(32)) & U64(0xFFFFFFFE) | (key & U64(1))).astype(np.uint32)
                yield _dealt(list(_deal(((key >> U64(1)) % U64(buckets)).astype(np.int64), block, short, line[own], sketch[own])))
    return run


def _met(edits: int):
    """Of a bucket: pairs of lines, one indexed and one probed under the same key, whose sketches allow the distance."""
    def run(key, rows):
        parts = [unpack(d, "u4", "u8", "u8") for d in rows.column("data").to_pylist()]
        k, line, sketch = (np.concatenate([p[c] for p in parts]) for c in range(3))
        order = np.lexsort((line, k))
        k, line, sketch = k[order], line[order], sketch[order]
        new = np.append(True, (k[1:] != k[:-1]) | (line[1:] != line[:-1]))  # a line that several blocks hold counts once
        k, line, sketch = k[new], line[new], sketch[new]
        group = k >> np.uint32(1)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        last = np.append(first[1:], len(k))
        middle = first + np.add.reduceat(1 - (k & np.uint32(1)).astype(np.int64), first) if len(k) else first
        some = np.flatnonzero((middle > first) & (middle < last))
        a, b = [], []
        for lo, mid, hi in zip(first[some].tolist(), middle[some].tolist(), last[some].tolist()):
            if hi - lo == 2:
                if line[lo] != line[mid] and int(sketch[lo] ^ sketch[mid]).bit_count() <= 4 * edits:
                    a.append(line[lo:mid])
                    b.append(line[mid:hi])
                continue
            for i in range(lo, mid):
                near = np.flatnonzero((np.bitwise_count(sketch[mid:hi] ^ sketch[i]) <= 4 * edits) & (line[mid:hi] != line[i]))
                a.append(np.full(len(near), line[i]))
                b.append(line[mid:hi][near])
        a, b = (signed(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in (a, b))
        low, high = np.minimum(a, b), np.maximum(a, b)
        pairs = np.unique(np.stack([low, high]), axis=1) if len(low) else np.zeros((2, 0), np.int64)
        return pa.table({"a": pairs[0], "b": pairs[1]})
    return run


def within(first: list[np.ndarray], second: list[np.ndarray], edits: int) -> np.ndarray:
    """Whether each pair of code point arrays is within the edit distance.

    Columns of the edit matrix are kept as vertical differences of the ``2 * edits + 1`` rows around the diagonal, one bit a
    row, and all pairs advance together.  The lowest row of the band gives the distance: it grows by one where a diagonal step
    costs, and runs along the last row once the band has reached it.
    """
    n = len(first)
    m, w = np.array([len(x) for x in first]), np.array([len(x) for x in second])
    result = np.abs(m - w) <= edits
    swap = m > w  # rows are the shorter line's
    rows = [y if s else x for x, y, s in zip(first, second, swap)]
    columns = [x if s else y for x, y, s in zip(first, second, swap)]
    m, w = np.minimum(m, w), np.maximum(m, w)
    if not n:
        return result
    band = 2 * edits + 1
    tall, wide = int(m.max()), int(w.max())
    a = np.full((n, max(tall, wide) + band + edits), 0xFFFFFFFF, np.uint32)
    b = np.full((n, wide), 0xFFFFFFFE, np.uint32)
    for i in range(n):
        a[i, edits:edits + len(rows[i])] = rows[i]
        b[i, : len(columns[i])] = columns[i]
    full = (1 << band) - 1
    # Row k of the band in column j is row j - edits + k of the matrix; rows above the matrix count down to its edge.
    plus, minus = np.full(n, full & ~((1 << edits) - 1), np.int64), np.zeros(n, np.int64)
    distance = np.minimum(m, edits)
    for j in range(wide):
        same = np.zeros(n, np.int64)
        for k in range(band):
            same |= (a[:, j + k] == b[:, j]).astype(np.int64) << k
        diagonal = ((((same & plus) + plus) ^ plus) | same | minus) & full
        across_plus = (minus | ~(diagonal | plus)) & full
        across_minus = diagonal & plus
        low = m - 1 - j + edits  # bit of the matrix's last row
        live = j < w
        inside = low >= band - 1
        step = np.where(inside, 1 - (diagonal >> (band - 1) & 1), (across_plus >> np.clip(low, 0, band - 1) & 1) - (across_minus >> np.clip(low, 0, band - 1) & 1))
        distance += np.where(live, step, 0)
        shifted = diagonal >> 1
        plus, minus = (across_minus | ~(shifted | across_plus)) & full, shifted & across_plus
    return result & (distance <= edits)


def _verified(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.frombuffer(v, np.uint32) for v in batch.column("ta").to_pylist()]
            y = [np.frombuffer(v, np.uint32) for v in batch.column("tb").to_pylist()]
            order = np.argsort([len(v) for v in x], kind="stable")
            keep, lo = [], 0
            while lo < len(order):
                size = len(x[order[lo]]) + 8
                hi = min(len(order), lo + max(1, min(4096, (1 << 20) // size)))
                while hi > lo + 1 and (len(x[order[hi - 1]]) + 8) * (hi - lo) > 1 << 21:
                    hi = lo + (hi - lo) // 2
                own = order[lo:hi]
                keep.append(own[within([x[i] for i in own], [y[i] for i in own], edits)])
                lo = hi
            keep = np.sort(np.concatenate(keep)) if keep else np.zeros(0, np.int64)
            yield batch.select(["a", "b"]).take(pa.array(keep))
    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, sizes, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            data = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([w["line"] for w in wanted], pa.int64()), pa.array([data[w["at"]:w["at"] + w["size"]].tobytes() for w in wanted], pa.binary())], ["line", "text"])


def _classes(text: DataFrame, buckets: int, edits: int) -> tuple[DataFrame, DataFrame]:
    """All lines, and (line, first document, number, occurrences, n_links, class) of the different ones."""
    rows = keep(text.mapInArrow(_line_rows, "line long, size int, doc long, number int, block long, at int"), "lines")
    place = F.struct("doc", "number", "block", "at", "size")
    first = keep(
        rows.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("occurrences")).select("line", "first.*", "occurrences"), "first")
    keys = text.mapInArrow(_keys(BUCKET_SHARE * buckets, edits), "bucket int, block long, data binary")
    pairs = keep(keys.groupBy("bucket").applyInArrow(_met(edits), "a long, b long").distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("line")).union(pairs.select("b")).distinct()
    wanted = first.join(wanted, "line", "left_semi").groupBy("block").agg(F.collect_list(F.struct("line", "at", "size")).alias("wanted")).hint("shuffle_hash")
    texts = keep(text.join(wanted, "block").select("block", "ids", "sizes", "text", "wanted").mapInArrow(_texts, "line long, text binary"), "texts")
    both = pairs.join(texts.select(F.col("line").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("line").alias("b"), F.col("text").alias("tb")), "b")
    links = keep(both.mapInArrow(_verified(edits), "a long, b long"), "links")
    degree = links.select(F.col("a").alias("line")).union(links.select("b")).groupBy("line").agg(F.count("*").alias("n_links"))
    labels = components(links)
    different = first.join(degree, "line", "left").join(labels.withColumnRenamed("id", "line"), "line", "left").select(
        "line", "size", "doc", "number", "occurrences", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "line").alias("class"))
    return rows, keep(different, "different")


def _documents(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).where("id is not null")


def line_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", edits: int = EDITS) -> DataFrame:
    """One row per different line: (id, line, size, occurrences, n_links, class_id, class_line).

    ``id`` and ``line`` (from 0) are its first occurrence in the order of ids and lines, ``n_links`` the different lines within
    the edit distance, and (class_id, class_line) the first occurrence in its class of linked lines.  Lines are what newlines
    separate; an empty or null text is one empty line; lines of under 16 characters link with nothing.  Rows with a null id are
    left out; rows with equal ids are different texts of one document.
    """
    with scratch(docs.sparkSession), text_blocks(_documents(docs, id_column, text_column)) as (text, buckets):
        _, different = _classes(text, buckets, edits)
        heads = different.groupBy("class").agg(F.min(F.struct("doc", "number")).alias("head"))
        found = different.join(heads, "class").select(
            F.col("doc").alias(id_column), F.col("number").alias("line"), "size", "occurrences", "n_links", F.col("head.doc").alias("class_id"), F.col("head.number").alias("class_line"))
        return write_table(found, "classes")


def line_members(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", edits: int = EDITS) -> DataFrame:
    """One row per line of every document: (id, line, size, occurrences, n_links, class_id, class_line, kept).

    The columns are those of ``line_classes``, with the line's own place as ``id`` and ``line``.  ``kept`` is false for the lines
    that ``without_near_lines`` takes out.
    """
    with scratch(docs.sparkSession), text_blocks(_documents(docs, id_column, text_column)) as (text, buckets):
        rows, different = _classes(text, buckets, edits)
        # A line without links is a class of its own.
        linked = different.where("n_links > 0")
        heads = linked.groupBy("class").agg(F.min(F.struct("doc", "number")).alias("head"))
        columns = ["line", "occurrences", "n_links", "head"]
        classes = linked.join(heads, "class").select(columns).union(
            different.where("n_links = 0").withColumn("head", F.struct("doc", "number")).select(columns))
        kept = (F.col("size") < LEAST) | (F.struct("doc", "number") == F.col("head"))
        found = rows.join(classes, "line").select(
            F.col("doc").alias(id_column), F.col("number").alias("line"), "size", "occurrences", "n_links", F.col("head.doc").alias("class_id"),
            F.col("head.number").alias("class_line"), kept.alias("kept"))
        return write_table(found, "members")


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, ids, sizes, text, marks in zip(*(c.to_pylist() for c in batch.columns)):
            gone = {(m["doc"], m["number"]) for m in marks or () if not m["new"]}
            fresh = {(m["doc"], m["number"]) for m in marks or () if m["new"]}
            at, out, removed, new = 0, [], [], []
            for i, size in zip(ids, sizes):
                lines = text[at:at + size].split(b"\n")
                kept = [k for k in range(len(lines)) if (i, k) not in gone]
                out.append(b"\n".join(lines[k] for k in kept).decode())
                removed.append(len(lines) - len(kept))
                new.append(sum(1 for k in kept if lines[k].decode().strip() and ((i, k) in fresh or len(lines[k].decode()) >= LEAST)))
                at += size
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string()), pa.array(removed, pa.int64()), pa.array(new, pa.int64())],
                ["id", "text", "n_removed", "n_new"])


def without_near_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", edits: int = EDITS) -> DataFrame:
    """(id, text, n_removed, n_new): every line of at least 16 characters whose class occurs earlier is taken out of its text.

    Earlier means in a smaller id, or before in the same text.  ``n_new`` counts the different lines left that are not blank and
    occur in no earlier document.  Ids should be unique; see ``line_classes`` for odd rows.
    """
    with scratch(docs.sparkSession), text_blocks(_documents(docs, id_column, text_column)) as (text, buckets):
        rows, different = _classes(text, buckets, edits)
        heads = different.groupBy("class").agg(F.min(F.struct("doc", "number")).alias("head"))
        several = different.groupBy("class").agg(F.sum("occurrences").alias("n")).where("n > 1")
        members = different.where(F.col("size") >= LEAST).join(several, "class").join(heads, "class").select("line", "head")
        gone = rows.join(members, "line").where(F.struct("doc", "number") > F.col("head"))
        # Every longer line that stays is new; of the short ones, which all stay, the first occurrence is.
        short = rows.where(f"size between 1 and {LEAST - 1}").groupBy("line").agg(F.min(F.struct("doc", "number", "block")).alias("first")).select("first.*")
        places = gone.select("block", "doc", "number", F.lit(False).alias("new")).union(short.select("block", "doc", "number", F.lit(True)))
        marks = places.groupBy("block").agg(F.collect_list(F.struct("doc", "number", "new")).alias("marks")).hint("shuffle_hash")
        done = text.join(marks, "block", "left").select("block", "ids", "sizes", "text", "marks").mapInArrow(_rest, "id long, text string, n_removed long, n_new long")
        return write_table(done, "rest", compression="zstd").withColumnRenamed("id", id_column)
