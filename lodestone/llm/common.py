"""Helpers shared by the operators: batches, hashing of bytes and words, connected components."""

from __future__ import annotations

import ctypes
import gc
import struct
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.session import shared_dir

U64 = np.uint64
BLOCK_BYTES = 1 << 20  # text handled at once by one numpy step; bounds a worker's memory, not the results


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A driver table with the wanted columns only."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


_SCRATCH: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``keep`` writes inside go at the end; what is returned must have been written outside or be read before."""
    path = shared_dir(spark)
    _SCRATCH.append(path)
    try:
        yield
    finally:
        _SCRATCH.remove(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def let_go(spark: SparkSession) -> None:
    """Shuffle files and broadcasts that nothing refers to any more are let go."""
    gc.collect()
    spark._jvm.System.gc()


def keep(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage; the shuffle files behind it are let go."""
    spark = df.sparkSession
    path = f"{_SCRATCH[-1] if _SCRATCH else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    del df
    let_go(spark)
    return out


def release_memory() -> None:
    """Gives what large arrays left in the allocator back to the system, where the C library can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def blocks(sizes: list[int], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes sum to about ``most``; a larger row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(n, 1 << 16).bit_length()
    if size not in _POWERS:
        inverse = pow(_BASE, -1, 1 << 64)
        both = []
        for base in (_BASE, inverse):
            p = np.full(size, base, U64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte values times powers; ``span_hash`` reads the hash of any span from them."""
    out = np.empty(len(data) + 1, U64)
    out[0] = 0
    np.cumsum(_BYTE[data] * _powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``; equal bytes give equal hashes wherever they stand."""
    inverse = _powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64) * U64(0xA0761D6478BD642F))


def char_prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``prefix_hash``, over code points; with the inverse powers that ``char_span`` needs."""
    powers = np.full(len(data) + 1, _BASE, U64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.full(len(data) + 1, pow(_BASE, -1, 1 << 64), U64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(mix(data.astype(U64) + U64(1)) * powers[:-1], out=sums[1:])
    return sums, inverse


def char_span(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of code points."""
    return mix(raw_span(prefix, start, end) + (end - start).astype(U64) * U64(0xA0761D6478BD642F))


def raw_span(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """As ``char_span`` for spans of one length, without the final mixing."""
    sums, inverse = prefix
    return (sums[end] - sums[start]) * inverse[start]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space: joined bytes, word starts, word ends, and words before each text (one more than texts)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
    starts, ends = edge[0::2], edge[1::2]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    return data, starts, ends, np.searchsorted(starts, bounds)


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the words before each text."""
    data, starts, ends, before = words(texts, lower)
    return span_hash(prefix_hash(data), starts, ends), before


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary value; ``unpack`` gives views of them."""
    parts = [np.ascontiguousarray(a) for a in arrays]
    head = struct.pack(f"<{len(parts)}q", *(a.nbytes for a in parts))
    return head + b"".join(a.tobytes() for a in parts)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{len(kinds)}q", blob)
    at, out = 8 * len(kinds), []
    for kind, size in zip(kinds, sizes):
        kind = np.dtype(kind)
        out.append(np.frombuffer(blob, kind, size // kind.itemsize, at))
        at += size
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over the undirected edges (a, b), for ids that have an edge.

    Alternating large-star and small-star steps, each a minimum per node joined back to the node's edges, so that a hub's
    edges are never gathered in one group.  Every round is written to the shared folder.
    """
    def written(rows: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges as a table, with their number and digest from the same job."""
        seen = Observation()
        digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        table = keep(rows.observe(seen, F.count(F.lit(1)).alias("n"), digest.alias("digest")), "edges")
        return table, (seen.get["n"], seen.get["digest"])

    e, state = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        e = e.where("u <> v")
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u")
        e, now = written(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct())
        if state == now:
            break
        state = now
    found = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
