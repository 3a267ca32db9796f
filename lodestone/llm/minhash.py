"""MinHash near-duplicates with an LSH forest.

Each text becomes the set of its distinct five-word shingles and a signature of 64 minima.  Texts with the same set are one
class.  Sixteen trees order the classes by rotated signatures; classes that share at least four leading minima of a tree form a
region, and inside it the neighbours in sorted order, which share the longest prefixes, are candidates: the more crowded a
region, the deeper the prefix that neighbours share.  Candidates are confirmed on full shingle sets.  Crowded regions that
still hold several components are then searched between components.

Two texts of similarity s meet in some region with probability 1 - (1 - s^4)^16: 0.99999 at 0.85 and 0.9998 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import U64, blocks, components, keep, mix, scratch, signed, utf8, word_hashes
from lodestone.session import write_table

SHINGLE = 5
MINIMA = 64
TREES = 16
DEPTH = 4
NEIGHBOURS = 8
ROUNDS = ((1, 1), (TREES, NEIGHBOURS))  # trees and distances of each round of candidates
BLOCK = 1024  # members of a crowded region that one task holds against as many others
# Fewer equal minima than this happen to a pair at the threshold once in a million: 5 standard deviations below its mean.
_DRAW = np.random.default_rng(20240607)
_A = _DRAW.integers(1 << 31, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
_B = _DRAW.integers(0, 1 << 32, MINIMA, dtype=np.uint32)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Per text the sorted distinct shingle hashes; a text of fewer words is one shingle, no words none."""
    hashes, before = word_hashes(texts)
    rolled = np.zeros(0, U64)
    if len(hashes) >= SHINGLE:
        n = len(hashes) - SHINGLE + 1
        rolled = hashes[:n].copy()
        for j in range(1, SHINGLE):
            rolled = rolled * U64(0x9FB21C651E98DF25) + hashes[j:j + n]
        rolled = mix(rolled)
    for i in range(len(texts)):
        lo, hi = before[i], before[i + 1]
        if hi - lo >= SHINGLE:
            yield np.unique(rolled[lo:hi - SHINGLE + 1])
        elif hi > lo:
            whole = U64(hi - lo)
            for h in hashes[lo:hi]:
                whole = mix(np.array([whole * U64(3) + h], U64))[0]
            yield np.array([whole], U64)
        else:
            yield np.zeros(0, U64)


def signature(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> U64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(out, (low[i:i + 2048, None] * _A + _B).min(axis=0), out=out)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
        for lo, hi in blocks([len(t) for t in texts]):
            n, k1, k2, sigs = [], [], [], []
            with np.errstate(over="ignore"):
                for s in shingle_sets(texts[lo:hi]):
                    n.append(len(s))
                    k1.append(int(mix(s).sum(dtype=U64)))
                    k2.append(int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)))
                    sigs.append(signature(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[lo:hi], pa.int64()), pa.array(n, pa.int64()), pa.array(signed(np.array(k1, U64))),
                 pa.array(signed(np.array(k2, U64))), pa.array(sigs, pa.binary())], ["id", "n", "k1", "k2", "sig"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class and tree: the region (hash of the first minima in the tree's order) and the path below it, a byte a level."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, MINIMA)
        rep = batch.column(0).to_numpy()
        for t in range(TREES):
            order = (DEPTH * t + np.arange(DEPTH + 8)) % MINIMA
            region = np.full(len(sig), t + 1, U64)
            for j in order[:DEPTH]:
                region = mix(region * U64(0x9E3779B97F4A7C15) + sig[:, j])
            path = np.zeros(len(sig), U64)
            for j in order[DEPTH:]:
                path = (path << U64(8)) | (mix(sig[:, j].astype(U64)) & U64(255))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(region)), pa.array(signed(path)), pa.array(rep), batch.column("n"), pa.array(np.full(len(sig), t, np.int32))],
                ["region", "path", "rep", "n", "tree"])


def _runs(steps: int, percent: int, crowd: int | None = None):
    """Sorted (region, path, rep, n, comp) rows: pairs at most ``steps`` apart in one region, of different components and of sizes that
    allow the threshold (next neighbours alone in a region of more than ``crowd`` rows), and the first and last ``steps`` rows of the task (with ``part`` and ``row``), whose neighbours may lie in
    another task."""
    names = ["a", "b", "part", "row", "region", "comp", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        region, rep, comp, size = (np.zeros(0, np.int64) for _ in range(4))

        def edge(lo: int, hi: int, first: int) -> pa.RecordBatch:
            n = hi - lo
            return pa.RecordBatch.from_arrays(
                [pa.array(rep[lo:hi]), pa.nulls(n, pa.int64()), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(first, first + n)),
                 pa.array(region[lo:hi]), pa.array(comp[lo:hi]), pa.array(size[lo:hi])], names)

        for batch in batches:
            old = len(rep)
            region, rep, comp, size = (
                np.concatenate((x, batch.column(c).to_numpy())) for x, c in ((region, "region"), (rep, "rep"), (comp, "comp"), (size, "n")))
            first = np.flatnonzero(np.append(True, region[1:] != region[:-1])[: len(region)])
            run_of = np.diff(np.append(first, len(region)))
            members = np.repeat(run_of, run_of)  # rows seen of each row's region, never more than it has
            for d in range(1, min(steps, len(rep) - 1) + 1):
                fits = 100 * np.minimum(size[d:], size[:-d]) >= percent * np.maximum(size[d:], size[:-d])
                if crowd is not None and d > 1:
                    fits &= members[d:] <= crowd
                hit = np.flatnonzero(fits & (region[d:] == region[:-d]) & (comp[d:] != comp[:-d]) & (rep[d:] != rep[:-d]) & (np.arange(d, len(rep)) >= old))
                a, b = rep[hit], rep[hit + d]
                none = len(hit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()),
                     pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64())], names)
            if seen < steps:
                yield edge(old, min(len(rep), old + steps - seen), seen)
            seen += batch.num_rows
            region, rep, comp, size = region[-steps:], rep[-steps:], comp[-steps:], size[-steps:]
        # The last rows, without those that are among the first.
        lo = max(0, len(rep) - (seen - steps)) if seen < 2 * steps else 0
        if seen > steps:
            yield edge(lo, len(rep), seen - len(rep) + lo)
    return run


def _neighbours(forest: DataFrame, steps: int, percent: int, crowd: int | None = None) -> DataFrame:
    """Different pairs (a, b) of one region within ``steps`` of each other whose components differ and whose sizes allow the threshold.

    The order is global, so a region of any size is spread over tasks.  With ``crowd``, a region of more rows may leave out pairs
    farther apart than one; whoever asks for that searches those regions otherwise.
    """
    sort = forest.repartitionByRange("region", "path", "rep").sortWithinPartitions("region", "path", "rep")
    found = keep(sort.mapInArrow(_runs(steps, percent, crowd), "a long, b long, part int, row long, region long, comp long, n long"), "runs")
    edges = found.where("part is not null")
    sizes = edges.groupBy("part").agg((F.max("row") + 1).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task of the sort
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    edges = edges.join(sizes, "part").select("region", F.struct((F.col("before") + F.col("row")).alias("at"), "part", F.col("a").alias("rep"), "comp", "n").alias("x"))
    order = Window.partitionBy("region").orderBy("x.at").rowsBetween(1, 2 * steps)
    met = edges.withColumn("near", F.collect_list("x").over(order)).select("x", F.explode("near").alias("y")).where(
        (F.col("y.at") - F.col("x.at") <= steps) & (F.col("x.part") != F.col("y.part")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.rep") != F.col("y.rep"))
        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")))
    met = met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    return found.where("b is not null").select("a", "b").union(met).distinct()


def _likely(percent: int):
    rate = percent / 100
    least = int(MINIMA * rate - 5 * (MINIMA * rate * (1 - rate)) ** 0.5)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("sig_a").to_pylist()), np.uint32).reshape(-1, MINIMA)
            y = np.frombuffer(b"".join(batch.column("sig_b").to_pylist()), np.uint32).reshape(-1, MINIMA)
            keep = np.flatnonzero((x == y).sum(axis=1) >= least)
            yield batch.select(["a", "b"]).take(pa.array(keep))
    return check


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
        for lo, hi in blocks([len(t) for t in texts]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[lo:hi], pa.int64()), pa.array([s.tobytes() for s in shingle_sets(texts[lo:hi])], pa.binary())],
                ["id", "shingles"])


def _reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(long, short)
    both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())):
                if _reaches(np.frombuffer(x, U64), np.frombuffer(y, U64), percent):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
    return check


def _likely_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and equal minima allow the threshold."""
    side = sketches.select(F.col("id"), "n", "sig")
    both = (
        pairs.join(side.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a")), "a")
        .join(side.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b")), "b")
        .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    )
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(_likely(percent), "a long, b long")


def _set_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Shingle sets of the texts in ``ids``; the texts are dealt by id at every size, so their shuffle grows as they do."""
    wanted = docs.join(ids.distinct().hint("shuffle_hash"), "id", "left_semi").select("id", "text")
    return keep(wanted.mapInArrow(_sets, "id long, shingles binary"), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that reach the threshold on full shingle sets."""
    both = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
    )
    return keep(both.mapInArrow(_confirmed(percent), "a long, b long"), "links")


def _between(percent: int):
    """Two blocks of a crowded region: links between different components, confirmed on full sets.

    Links that only repeat a connection found in the same two blocks are left out.
    """
    rate = percent / 100
    least = int(MINIMA * rate - 5 * (MINIMA * rate * (1 - rate)) ** 0.5)

    def search(key, left, right):
        sides = []
        for side in (left, right):
            sets = [np.frombuffer(x, U64) for x in side.column("shingles").to_pylist()]
            with np.errstate(over="ignore"):
                sigs = np.array([signature(x) for x in sets], np.uint32).reshape(-1, MINIMA)
            sides.append((side.column("id").to_numpy(), side.column("component").to_numpy(), sets, sigs, np.array([len(x) for x in sets], np.int64)))
        (ids_a, comp_a, sets_a, sigs_a, n_a), (ids_b, comp_b, sets_b, sigs_b, n_b) = sides
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        a, b = [], []
        for i in range(len(ids_a) if len(ids_b) else 0):
            fits = 100 * np.minimum(n_b, n_a[i]) >= percent * np.maximum(n_b, n_a[i])
            hit = np.flatnonzero(fits & (comp_b != comp_a[i]) & ((sigs_b == sigs_a[i]).sum(axis=1) >= least))
            for j in hit.tolist():
                x, y = root(int(comp_a[i])), root(int(comp_b[j]))
                if x != y and _reaches(sets_a[i], sets_b[j], percent):
                    parent[max(x, y)] = min(x, y)
                    a.append(int(ids_a[i]))
                    b.append(int(ids_b[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return search


def _classes(docs: DataFrame, percent: int) -> DataFrame:
    sketches = keep(docs.mapInArrow(_sketch, "id long, n long, k1 long, k2 long, sig binary"), "sketches")
    full = sketches.where("n > 0 and id is not null")
    classes = keep(full.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep")), "classes")
    reps = keep(
        full.select("id", "n", "k1", "k2", "sig").join(classes.select(F.col("rep").alias("id"), "k1", "k2", "n"), ["id", "k1", "k2", "n"], "left_semi")
        .dropDuplicates(["id", "k1", "k2"]), "reps").select("id", "n", "sig")

    forest = keep(reps.select("id", "sig", "n").mapInArrow(_forest, "region long, path long, rep long, n long, tree int"), "forest")
    crowded = forest.groupBy("region").agg(F.count("*").alias("members")).where(F.col("members") > NEIGHBOURS + 1)
    crowd = keep(forest.join(crowded, "region").select("region", "members", F.col("rep").alias("id")), "crowd")
    links = labels = None

    def label(df: DataFrame, column: str, name: str) -> DataFrame:
        if labels is None:
            return df.withColumn(name, F.col(column))
        side = labels.select(F.col("id").alias(column), F.col("component").alias(name))
        return df.join(side, column, "left").withColumn(name, F.coalesce(name, column))

    # Next neighbours in few trees link most of what belongs together; later rounds compare across components only.
    for trees, steps in ROUNDS:
        # All pairs of a crowded region are searched between components below; next neighbours leave few of them.
        pairs = _neighbours(label(forest.where(F.col("tree") < trees), "rep", "comp"), steps, percent, NEIGHBOURS + 1)
        likely = keep(_likely_pairs(pairs, reps, percent), "likely")
        found = _confirm(likely, _set_table(docs, likely.select(F.col("a").alias("id")).union(likely.select("b"))), percent)
        links = found if links is None else links.union(found)
        labels = keep(components(links), "labels")

    inside = label(crowd, "id", "component")
    split = inside.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("region")
    inside = inside.join(split, "region").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    inside = inside.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    inside = keep(inside.join(_set_table(docs, inside.select("id")), "id"), "inside")
    left = inside.withColumn("against", F.explode(F.sequence("block", F.col("blocks") - 1)))
    right = inside.withColumn("against", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("block"))))
    keys, columns = ["region", "block", "against"], ["region", "block", "against", "id", "component", "shingles"]
    beyond = left.select(columns).groupBy(keys).cogroup(right.select(columns).groupBy(keys)).applyInArrow(_between(percent), "a long, b long")
    links = links.union(keep(beyond, "links"))
    labels = keep(components(links), "labels")

    of_class = classes.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    return sketches.join(of_class, ["k1", "k2", "n"], "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of ``docs``; links need 100 * intersection >= percent * union.

    Null, empty and white-space texts have an empty set and link with nothing; rows with the same id are rows of their own with
    one component; rows with a null id come back with null component and kept true.  Extra columns are ignored.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    with scratch(docs.sparkSession):
        return write_table(_classes(docs, percent), "classes").withColumnRenamed("id", id_column)
