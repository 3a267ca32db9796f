"""Embedding near-duplicates by collision counting on one-dimensional projections.

Unit vectors are projected on many random directions and each direction's projections are sorted.  A vector queries the
directions on which its projection lies in the upper tail, where the sorted order is sparse; its collisions there are the vectors
within a window centred on its own projection.  Pairs are counted over all directions, and pairs that reach the count threshold
are verified by their cosine in double precision.

``calibrate`` chooses tail, window and number of directions from the number of vectors: a pair at the threshold is expected to
collide so often that it misses the count with the stated probability only.  The tail shrinks with the square root of the
number of vectors, so projections and collisions both grow as its power 1.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import components, keep, prefix_hash, scratch, signed, span_hash
from lodestone.session import write_table

COUNT = 2  # collisions that make a candidate
MISS = 0.003  # probability that a pair at the threshold collides less often
WINDOW = 1.4  # half width, in standard deviations of a projection
TAIL = 0.113  # share of vectors in a tail, times the square root of their number
LIST = 1024  # members of one direction's list that a task holds against as many others
SEED = 99


def _upper(p: float) -> float:
    """The point that a standard normal exceeds with probability ``p``."""
    lo, hi = -8.0, 8.0
    while hi - lo > 1e-10:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erfc(mid / 2 ** 0.5) / 2 > p else (lo, mid)
    return lo


def calibrate(n: int, cosine: float) -> tuple[float, int]:
    """Tail start and number of directions for ``n`` vectors."""
    tail = _upper(min(0.05, TAIL / max(1.0, n) ** 0.5))
    # P(both in the tail and inside the window) for projections of correlation ``cosine``, by a sum over the first one.
    x = np.arange(tail, tail + 8, 1e-3)
    spread = (1 - cosine * cosine) ** 0.5

    def below(v):
        return np.array([0.5 * math.erfc(-t / 2 ** 0.5) for t in v])
    near = below((np.minimum(x + WINDOW, 50) - cosine * x) / spread) - below((np.maximum(x - WINDOW, tail) - cosine * x) / spread)
    both = float((np.exp(-x * x / 2) / (2 * math.pi) ** 0.5 * near).sum() * 1e-3)
    mean = float(COUNT)
    while math.exp(-mean) * sum(mean ** k / math.factorial(k) for k in range(COUNT)) > MISS:
        mean += 0.01
    return tail, math.ceil(mean / both)


_DIRECTIONS: dict[tuple[int, int], np.ndarray] = {}


def directions(size: int, count: int) -> np.ndarray:
    if (size, count) not in _DIRECTIONS:
        _DIRECTIONS.clear()
        _DIRECTIONS[size, count] = np.random.default_rng(SEED + size).standard_normal((size, count), dtype=np.float32)
    return _DIRECTIONS[size, count]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a usable vector: id, size, hash of the components, components as doubles."""
    for batch in batches:
        out = {"id": [], "size": [], "k1": [], "vector": []}
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not v or any(x is None for x in v):
                continue
            x = np.array(v, np.float64) + 0.0  # no negative zeros
            top = np.abs(x).max()
            if not np.isfinite(x).all() or top == 0:
                continue
            x = x / 2.0 ** np.frexp(top)[1]  # exact; keeps squares in range
            raw = x.tobytes()
            data = np.frombuffer(raw, np.uint8)
            h = span_hash(prefix_hash(data), np.array([0]), np.array([len(data)]))
            out["id"].append(i)
            out["size"].append(len(x))
            out["k1"].append(int(signed(h)[0]))
            out["vector"].append(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["id"], pa.int64()), pa.array(out["size"], pa.int32()), pa.array(out["k1"], pa.int64()), pa.array(out["vector"], pa.binary())],
            ["id", "size", "k1", "vector"])


def _tails(tail: float, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column("id").to_numpy(), batch.column("size").to_numpy()
            vectors = batch.column("vector").to_pylist()
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                a = directions(size, count)
                for lo in range(0, len(own), 256):
                    some = own[lo:lo + 256]
                    x = np.frombuffer(b"".join(vectors[i] for i in some), np.float64).reshape(-1, size)
                    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                    for at in range(0, count, 8192):
                        p = x @ a[:, at:at + 8192]
                        row, column = np.nonzero(p >= tail)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(row), size, np.int32)), pa.array((column + at).astype(np.int32)), pa.array(p[row, column]), pa.array(ids[some[row]])],
                            ["size", "direction", "value", "id"])
    return run


def _collisions(key, rows):
    """Pairs of two blocks of a direction (or of one with itself) within each other's window."""
    first, second = key[2].as_py(), key[3].as_py()
    value, ids, block = rows.column("value").to_numpy(), rows.column("id").to_numpy(), rows.column("block").to_numpy()
    order = np.argsort(value, kind="stable")
    value, ids, block = value[order], ids[order], block[order]
    end = np.searchsorted(value, value + np.float32(WINDOW), side="right")
    a, b = [], []
    for i in range(len(ids)):
        other = np.arange(i + 1, end[i])
        if first != second:
            other = other[block[other] != block[i]]
        a.append(np.full(len(other), ids[i]))
        b.append(ids[other])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _verified(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist())):
                x, y = np.frombuffer(x, np.float64), np.frombuffer(y, np.float64)
                if x @ y >= cosine * math.sqrt(x @ x) * math.sqrt(y @ y):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
    return run


def _linked(df: DataFrame, cosine: float) -> DataFrame:
    vectors = keep(df.where("id is not null").mapInArrow(_vectors, "id long, size int, k1 long, vector binary"), "vectors")
    classes = keep(vectors.groupBy("size", "k1", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    n = classes.count()
    tail, count = calibrate(n, cosine)

    reps = classes.select(F.col("rep").alias("id"), "size", "vector")
    tails = keep(reps.repartition("id").mapInArrow(_tails(tail, count), "size int, direction int, value float, id long"), "tails")
    lists = tails.groupBy("size", "direction").agg(F.ceil(F.count("*") / LIST).cast("int").alias("blocks"))
    dealt = tails.join(lists, ["size", "direction"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    k = F.col("block")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, k).alias("first"), F.greatest(j, k).alias("second")))
    dealt = dealt.select("size", "direction", "block", "value", "id", F.explode(pair).alias("pair"))
    dealt = dealt.select("size", "direction", "pair.first", "pair.second", "block", "value", "id")
    collisions = dealt.groupBy("size", "direction", "first", "second").applyInArrow(_collisions, "a long, b long")
    candidates = collisions.groupBy("a", "b").agg(F.count("*").alias("hits")).where(F.col("hits") >= COUNT)
    both = candidates.select("a", "b").join(reps.select(F.col("id").alias("a"), F.col("vector").alias("va")), "a").join(
        reps.select(F.col("id").alias("b"), F.col("vector").alias("vb")), "b")
    links = keep(both.mapInArrow(_verified(cosine), "a long, b long"), "links")

    copies = classes.select(F.col("rep").alias("b"), "copies")
    each = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(copies, "b")
    degree = each.groupBy("a").agg(F.sum("copies").alias("others"))
    labels = components(links)
    found = classes.join(degree.withColumnRenamed("a", "rep"), "rep", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    found = found.select(
        "size", "k1", "vector", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    member = vectors.join(found, ["size", "k1", "vector"]).select("id", "n_links", "component")
    result = df.select("id").join(member.dropDuplicates(["id"]), "id", "left")
    component = F.coalesce("component", "id")
    return result.select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def linked_vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept) per row.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing.  Vectors of different lengths
    do not link.  Equal vectors are one class and linked with each other; rows with a null id come back without links.
    """
    df = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"))
    with scratch(df.sparkSession):
        return write_table(_linked(df, cosine), "linked").withColumnRenamed("id", id_column)
