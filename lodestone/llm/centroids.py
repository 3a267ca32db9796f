"""Centroid clustering on integer vectors: a tournament of bisecting planes finds each vector's nearest centroid.

The plane halfway between centroids i < j has the integer normal 2 * (c_j - c_i) and the threshold |c_j|^2 - |c_i|^2; a vector
whose product with the normal is above the threshold is nearer to j, and one on the plane stays with i, the smaller number.  A
vector meets centroids 1, 2, ... in turn, each time against the winner so far, so k - 1 sign tests leave one centroid, and only
that one's distance is worked out.  All arithmetic is in integers.

A round is one pass over the written table of integer vectors: every task adds up the components of its vectors per centroid,
and k x components sums are added across tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import keep, scratch
from lodestone.session import write_table

SCALE = 1024
NARROW = 1 << 24  # components and centroids below this keep every product and sum of 64-bit integers exact up to 4,096 components
LONG = 1 << 63


def integers(values: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of doubles; Python integers where a 64-bit one could be too small for exact products."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values.astype(np.float64) * SCALE)
    if not scaled.size or np.abs(scaled).max() < NARROW:
        return scaled.astype(np.int64)
    # A double times a power of two is exact until it overflows, so very large ones are scaled as fractions.
    whole = [int(v * SCALE // 1) if abs(v) < 1e300 else int(v) * SCALE for v in values.astype(np.float64).ravel().tolist()]
    return np.array(whole, object).reshape(values.shape)


def _usable(size: int):
    """Rows with ``size`` finite components: id, and the integers as text joined by commas."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            lengths = np.asarray(column.value_lengths().fill_null(-1))
            own = np.flatnonzero(lengths == size)
            flat = column.take(pa.array(own)).flatten()
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
            fine = np.isfinite(values).all(axis=1)  # nulls came out as NaN
            whole = integers(values[fine])
            wide = whole.dtype == object
            rows = [",".join(map(str, r)) for r in whole.tolist()] if wide else [None] * len(whole)
            narrow = [None] * len(whole) if wide else [r.astype("<i4").tobytes() for r in whole]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(own[fine])), pa.array(narrow, pa.binary()), pa.array(rows, pa.string())], ["id", "narrow", "wide"])
    return run


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    narrow, wide = batch.column("narrow"), batch.column("wide")
    if not wide.null_count == len(wide):
        rows = [np.frombuffer(a, "<i4").tolist() if b is None else [int(v) for v in b.split(",")] for a, b in zip(narrow.to_pylist(), wide.to_pylist())]
        return np.array(rows, object).reshape(-1, size)
    return np.frombuffer(b"".join(narrow.to_pylist()), "<i4").reshape(-1, size).astype(np.int64)


class Bisectors:
    """Normals and thresholds of all centroid pairs."""

    def __init__(self, centroids: list[list[int]]):
        small = all(abs(v) < NARROW for c in centroids for v in c)
        self.kind = np.int64 if small else object
        self.centroids = np.array(centroids, self.kind).reshape(len(centroids), -1)
        norms = (self.centroids * self.centroids).sum(axis=1)
        k = len(centroids)
        self.normal = {(i, j): 2 * (self.centroids[j] - self.centroids[i]) for i in range(k) for j in range(i + 1, k)}
        self.threshold = {(i, j): norms[j] - norms[i] for i in range(k) for j in range(i + 1, k)}

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner and squared distance per row of ``x``."""
        if x.dtype == object or self.kind is object:
            x = x.astype(object)
        winner = np.zeros(len(x), np.int64)
        for j in range(1, len(self.centroids)):
            for i in np.unique(winner).tolist():
                own = np.flatnonzero(winner == i)
                side = (x[own] * self.normal[i, j]).sum(axis=1)
                winner[own[(side > self.threshold[i, j]).astype(bool)]] = j
        gap = x - self.centroids[winner]
        return winner, (gap * gap).sum(axis=1)


def _limbs(total: int) -> list[tuple[int, int]]:
    """Digits of a whole number to the base 2^32, each with its place and the number's sign."""
    sign, rest = (-1 if total < 0 else 1), abs(total)
    return [(p, sign * (rest >> 32 * p & 0xFFFFFFFF)) for p in range(-(-rest.bit_length() // 32))]


def _sums(bisectors: Bisectors, size: int):
    """Per centroid and component the sum over the task's vectors in limbs; component -1 is their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(bisectors.centroids)
        total = [[0] * (size + 1) for _ in range(k)]
        for batch in batches:
            x = _matrix(batch, size)
            winner, _ = bisectors.nearest(x)
            for c in np.unique(winner).tolist():
                own = x[winner == c]
                total[c] = [a + int(b) for a, b in zip(total[c], [*own.sum(axis=0).tolist(), len(own)])]
        rows = [(c, d if d < size else -1, p, v) for c in range(k) for d in range(size + 1) for p, v in _limbs(total[c][d])]
        columns = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "component", "limb", "value"])
    return run


def _next(vectors: DataFrame, centroids: list[list[int]], size: int) -> list[list[int]]:
    """The centroids after one round: floor of the mean, or as before where no vector came."""
    parts = vectors.mapInArrow(_sums(Bisectors(centroids), size), "cluster int, component int, limb int, value long")
    sums: dict[tuple[int, int], int] = {}
    for row in parts.groupBy("cluster", "component", "limb").agg(F.sum("value").alias("value")).collect():  # centroids x components
        key = row["cluster"], row["component"]
        sums[key] = sums.get(key, 0) + (row["value"] << 32 * row["limb"])
    return [[sums.get((j, d), 0) // sums[j, -1] for d in range(size)] if (j, -1) in sums else c for j, c in enumerate(centroids)]


def _assigned(bisectors: Bisectors, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            winner, distance = bisectors.nearest(_matrix(batch, size))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(winner, pa.int32()), pa.array([str(d) for d in distance.tolist()], pa.string())], ["id", "cluster", "exact"])
    return run


def clusters(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 8, rounds: int = 10, size: int = 64,
             salt: str = "3") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector with exactly ``size`` finite components.

    Centroids start as the ``k`` vectors with the smallest sha256 of ``salt:id`` (ties: by the vector); with fewer vectors there are
    fewer centroids.  Rows with the same id are rows of their own.  A row with a null id is clustered like any other but starts no
    centroid; if no row has an id, the result is empty.  Vectors that are null, of another length or hold a null or non-finite
    component are left out.  Distances and sums beyond a 64-bit integer come back as null.  Extra columns are ignored.
    """
    spark = df.sparkSession
    usable = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector")).where(F.size("vector") == size)
    schema = "id long, narrow binary, wide string"
    with scratch(spark):
        vectors = keep(usable.mapInArrow(_usable(size), schema), "vectors")
        drawn = vectors.where("id is not null").withColumn("draw", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256))
        first = drawn.orderBy("draw", "narrow", "wide").limit(k).collect()  # k rows
        centroids = [np.frombuffer(r["narrow"], "<i4").tolist() if r["wide"] is None else [int(v) for v in r["wide"].split(",")] for r in first]
        for _ in range(rounds if centroids else 0):
            after = _next(vectors, centroids, size)
            if after == centroids:
                break  # every later round would repeat this one
            centroids = after
        if not centroids:
            vectors = vectors.limit(0)
        assigned = vectors.mapInArrow(_assigned(Bisectors(centroids or [[0] * size]), size), "id long, cluster int, exact string")
        assigned = write_table(assigned, "assigned")
    exact = F.col("exact").try_cast("decimal(38,0)")
    totals = assigned.groupBy("cluster").agg(F.sum(exact).alias("total"), F.count_if(exact.isNull()).alias("over")).collect()  # k rows

    def long(total, over) -> int | None:
        return int(total) if not over and total is not None and int(total) < LONG else None

    whole = long(sum(int(r["total"] or 0) for r in totals), sum(r["over"] for r in totals))
    facts = [(r["cluster"], long(r["total"], r["over"]), whole, hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in totals]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias(id_column), "cluster", exact.try_cast("long").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")
