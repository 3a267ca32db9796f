"""Exact vector search and its use beside lexical candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import vocab as V
from lodestone.operators.retrieval import top_k
from lodestone.operators.scoring import blended_topk, rank_scored, score_candidates
from lodestone.session import at_most, write_table

# Queries per block and vectors per block: bounds one task's matrices to a few hundred megabytes.
QUERY_BLOCK = 2048
VECTOR_BLOCK = 50_000
_MATCHES = "query_id string, parent_asin string, similarity double"


def query_encoder(encode: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """A user's text encoder as a vectorized column function, run batch by batch."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encoded(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encode(texts.tolist())))

    return encoded


def invalid_vectors(vectors: DataFrame, dimensions: int, key: str = "parent_asin", unit: bool = True) -> DataFrame:
    """One row of violation counts: rows, repeated ids, wrong width, not finite, not of unit length."""
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    count = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("bigint")
    per_row = vectors.select(
        F.col(key).alias("id"), (F.size("embedding") != dimensions).alias("width"), (~finite).alias("bad"),
        (F.abs(F.sqrt(square) - 1.0) > 1e-3).alias("norm") if unit else F.lit(False).alias("norm"))
    per_id = per_row.groupBy("id").agg(
        F.count("*").alias("n"), count(F.col("width")).alias("width"), count(F.col("bad")).alias("bad"), count(F.col("norm")).alias("norm"))
    return per_id.agg(
        F.sum("n").alias("rows"), count(F.col("n") > 1).alias("repeated_ids"), F.sum("width").alias("wrong_width"),
        F.sum("bad").alias("not_finite"), F.sum("norm").alias("not_unit"))


def normalized_queries(queries: DataFrame, dimensions: int) -> DataFrame:
    """Unit query vectors; a zero, non-finite or wrongly sized vector is an error."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = (F.size("embedding") == dimensions) & finite & (norm > 0)
    checked = F.when(good, norm).otherwise(F.raise_error(F.lit("query vector must be finite, nonzero and of the right size")))
    return queries.select(
        F.col("query_id").cast("string").alias("query_id"),
        F.transform("embedding", lambda x: x.cast("double") / checked).alias("embedding"))


def _best(query_ids, query_matrix, ids, matrix, k: int) -> pd.DataFrame:
    """Best ``k`` of one block of vectors for one block of queries."""
    similarity = np.round(query_matrix @ matrix.T, 9)
    take = min(k, len(ids))
    order = np.lexsort((np.broadcast_to(np.argsort(np.argsort(ids)), similarity.shape), -similarity), axis=1)[:, :take]
    return pd.DataFrame({
        "query_id": np.repeat(query_ids, take), "parent_asin": ids[order.ravel()],
        "similarity": np.take_along_axis(similarity, order, axis=1).ravel()})


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, dimensions: int) -> DataFrame:
    """Exact top ``k`` by cosine over unit vectors; equal similarities fall to the smaller id.

    Queries that fit one block go to every task and each batch of vectors yields at most ``k`` rows per query.
    More queries than that are cut into blocks which meet blocks of vectors; again only the best ``k`` of each
    pair of blocks leave the task, so pairs of rows are never written out.
    """
    spark = vectors.sparkSession
    unit = normalized_queries(queries, dimensions)
    rows = vectors.select(F.col("parent_asin").cast("string").alias("parent_asin"), F.col("embedding").cast("array<double>").alias("embedding"))
    if at_most(unit, QUERY_BLOCK):
        local = unit.toPandas()
        if local.empty:
            return spark.createDataFrame([], _MATCHES + ", rank int")
        shared = spark.sparkContext.broadcast((local["query_id"].to_numpy(), np.stack(local["embedding"].to_numpy())))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            query_ids, matrix = shared.value
            for batch in batches:
                if len(batch):
                    yield _best(query_ids, matrix, batch["parent_asin"].to_numpy(), np.stack(batch["embedding"].to_numpy()), k)

        matches = rows.mapInPandas(search, _MATCHES)
    else:
        query_blocks = max(1, -(-unit.count() // QUERY_BLOCK))
        vector_blocks = max(1, -(-rows.count() // VECTOR_BLOCK))
        left = unit.withColumn("qb", F.expr(f"pmod(xxhash64(query_id), {query_blocks})")).withColumn(
            "vb", F.explode(F.sequence(F.lit(0), F.lit(vector_blocks - 1)).cast("array<bigint>")))
        right = rows.withColumn("vb", F.expr(f"pmod(xxhash64(parent_asin), {vector_blocks})")).withColumn(
            "qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<bigint>")))

        def pair(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            if q.empty or v.empty:
                return pd.DataFrame({"query_id": [], "parent_asin": [], "similarity": []})
            return _best(
                q["query_id"].to_numpy(), np.stack(q["embedding"].to_numpy()),
                v["parent_asin"].to_numpy(), np.stack(v["embedding"].to_numpy()), k)

        matches = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(pair, _MATCHES)
    return top_k(matches, k, F.desc("similarity"), F.asc("parent_asin"))


# Vectors of one cell that a task holds, and queries that it answers with them.
CELL_PART = 4096
CELL_QUERIES = 1024


class CellIndex:
    """Unit vectors by their nearest pivot; a cell knows the widest angle between its pivot and a member."""

    def __init__(self, members: DataFrame, cells: DataFrame, pivots: np.ndarray):
        self.members = members  # cell, part, parent_asin, embedding
        self.cells = cells      # cell, radius, vectors
        self.pivots = pivots


def build_cells(vectors: DataFrame, cells: int | None = None) -> CellIndex:
    """Cells around pivots drawn by hash: about the root of the number of vectors, so cells and members of a cell grow alike.

    Pivots go to every task; at 10^8 vectors of 64 components they take 5 MB.
    """
    rows = vectors.select(F.col("parent_asin").cast("string").alias("parent_asin"), F.col("embedding").cast("array<double>").alias("embedding"))
    total = rows.count()
    wanted = cells or max(1, int(total ** 0.5))
    drawn = rows.orderBy(F.xxhash64("parent_asin"), "parent_asin").limit(wanted).select("embedding").collect()
    pivots = np.array([r[0] for r in drawn], np.float64)
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cosine = np.clip(np.stack(batch["embedding"].to_numpy()) @ shared.value.T, -1.0, 1.0)
                cell = cosine.argmax(axis=1)
                yield batch.assign(cell=cell, angle=np.arccos(cosine[np.arange(len(batch)), cell]))

    members = write_table(rows.mapInPandas(assign, "parent_asin string, embedding array<double>, cell int, angle double"), "cells")
    sizes = write_table(members.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("vectors")), "cell_sizes")
    part = F.expr(f"cast(pmod(xxhash64(parent_asin), greatest(1, ceil(vectors / {CELL_PART}))) as int)")
    return CellIndex(members.join(sizes, "cell").select("cell", part.alias("part"), "parent_asin", "embedding"), sizes, pivots)


def _cell_bounds(index: CellIndex, unit: DataFrame) -> DataFrame:
    """(query_id, cell, vectors, bound): no member of the cell has a larger cosine, by the triangle inequality of angles."""
    sc = unit.sparkSession.sparkContext
    facts = {r["cell"]: (r["radius"], r["vectors"]) for r in index.cells.collect()}  # one row per pivot
    cell = np.array(sorted(facts), np.int64)
    radius, size = np.array([facts[c][0] for c in cell.tolist()]), np.array([facts[c][1] for c in cell.tolist()], np.int64)
    shared = sc.broadcast((index.pivots, cell, radius, size))

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, cell, radius, size = shared.value
        for batch in batches:
            if len(batch) and len(cell):
                angle = np.arccos(np.clip(np.stack(batch["embedding"].to_numpy()) @ pivots[cell].T, -1.0, 1.0))
                best = np.cos(np.maximum(0.0, angle - radius))
                yield pd.DataFrame({
                    "query_id": np.repeat(batch["query_id"].to_numpy(), len(cell)), "cell": np.tile(cell, len(batch)), "vectors": np.tile(size, len(batch)),
                    "bound": best.ravel()})

    return unit.mapInPandas(bounds, "query_id string, cell int, vectors long, bound double")


def _search_cells(index: CellIndex, unit: DataFrame, routes: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of every part of the routed cells.  ``routes``: query_id, cell."""
    groups = max(1, -(-unit.count() // CELL_QUERIES))
    asked = routes.select("query_id", "cell").join(unit, "query_id").withColumn("group", F.expr(f"cast(pmod(xxhash64(query_id), {groups}) as int)"))
    parts = index.members.select("cell", "part").distinct()
    wanted = asked.select("cell", "group").distinct()
    left = asked.join(parts, "cell").select(F.col("cell").alias("cell"), F.col("part").alias("part"), F.col("group").alias("group"), "query_id", "embedding")
    right = index.members.join(wanted, "cell").select(F.col("cell").alias("cell"), F.col("part").alias("part"), F.col("group").alias("group"), "parent_asin", "embedding")

    def pair(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame({"query_id": [], "parent_asin": [], "similarity": []})
        ids, matrix = v["parent_asin"].to_numpy(), np.stack(v["embedding"].to_numpy())
        return _best(q["query_id"].to_numpy(), np.stack(q["embedding"].to_numpy()), ids, matrix, k)

    keys = ["cell", "part", "group"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, _MATCHES)


def cell_topk(index: CellIndex, queries: DataFrame, k: int, dimensions: int) -> DataFrame:
    """As ``dense_topk``, exact, reading only cells that can hold one of the best ``k``.

    The cells with the highest bounds that together hold ``k`` vectors are searched first; a cell whose bound is under the k-th cosine
    found there is skipped.
    """
    unit = write_table(normalized_queries(queries, dimensions), "unit_queries")
    bounds = _cell_bounds(index, unit)
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell")
    before = F.coalesce(F.sum("vectors").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = write_table(bounds.withColumn("first", before < k), "cell_bounds")
    head = write_table(top_k(_search_cells(index, unit, bounds.where("first"), k), k, F.desc("similarity"), F.asc("parent_asin")), "head")
    kth = head.where(F.col("rank") == k).select("query_id", F.col("similarity").alias("kth"))
    routes = bounds.where("not first").join(kth, "query_id", "left").where(F.coalesce(F.col("bound") >= F.col("kth") - 1e-8, F.lit(True)))
    found = head.drop("rank").unionByName(_search_cells(index, unit, routes, k))
    return top_k(found, k, F.desc("similarity"), F.asc("parent_asin"))


def dense_scores(matches: DataFrame, mode: str = "margin") -> DataFrame:
    """Similarities calibrated per query: ``margin`` above the weakest match, or ``minmax`` to [0, 1]."""
    if mode not in ("margin", "minmax"):
        raise ValueError("mode must be margin or minmax")
    w = Window.partitionBy("query_id")
    low, high, n = F.min("similarity").over(w), F.max("similarity").over(w), F.count("*").over(w)
    if mode == "margin":
        value = F.greatest(F.lit(0.0), F.col("similarity") - low)
    else:
        value = F.when(high - low > 1e-12, (F.col("similarity") - low) / (high - low)).otherwise(0.0)
    return matches.withColumn("dense_score", F.round(F.when(n == 1, 1.0).otherwise(value), 9))


def hybrid_pool(lexical_pool: DataFrame, dense: DataFrame) -> DataFrame:
    """Lexical and category candidates with dense matches added; one row per (query, product)."""
    a = lexical_pool.select("query_id", "parent_asin", "lexical_rank")
    b = dense.select("query_id", "parent_asin", F.lit(None).cast("int").alias("lexical_rank"))
    return a.unionByName(b).groupBy("query_id", "parent_asin").agg(F.max("lexical_rank").alias("lexical_rank"))


def hybrid_topk(
    lexical: DataFrame, dense: DataFrame, queries: DataFrame, products: DataFrame, stats: DataFrame, k: int, dense_limit: int,
    weights: dict[str, float] | None = None, requires_constraints: bool = True,
) -> DataFrame:
    """Best ``k`` of lexical hits, the query's category and dense matches by blended score.

    ``dense``: query_id, parent_asin, similarity, dense_score; at most ``dense_limit`` a query.  A product without a dense match is ordered by
    its base score alone, so the best ``k + dense_limit`` by base score and all dense matches hold the answer.
    """
    base = blended_topk(lexical, queries, products, stats, k + dense_limit).drop("rank")
    ranks = lexical.select("query_id", "parent_asin", F.col("rank").alias("lexical_rank"))
    counts = ranks.groupBy("query_id").agg(F.max("lexical_rank").alias("lexical_count"))
    matched = dense.select("query_id", "parent_asin").join(ranks, ["query_id", "parent_asin"], "left").join(counts, "query_id", "left")
    scored = base.unionByName(score_candidates(matched, queries, products, stats)).dropDuplicates(["query_id", "parent_asin"])
    known = queries.select("query_id", (F.size("constraints") > 0).alias("has_constraints"))
    return hybrid_rank(scored, dense, known, weights, requires_constraints).where(F.col("rank") <= k)


def hybrid_rank(
    scored: DataFrame, dense: DataFrame, has_constraints: DataFrame, weights: dict[str, float] | None = None,
    requires_constraints: bool = True,
) -> DataFrame:
    """Blend base and dense scores by intent; order by blend, dense score, lexical rank, id."""
    weights = weights or V.EMBEDDING_WEIGHTS
    if set(weights) != {"buying", "browsing"} or not all(0 <= w < 1 for w in weights.values()):
        raise ValueError("weights for buying and browsing must lie in [0, 1)")
    weight = F.when(F.col("intent") == "buying", weights["buying"]).otherwise(weights["browsing"])
    if requires_constraints:
        weight = F.when(F.col("has_constraints"), weight).otherwise(0.0)
    rows = (
        scored.withColumnRenamed("score", "base_score")
        .join(dense.select("query_id", "parent_asin", "similarity", "dense_score"), ["query_id", "parent_asin"], "left")
        .join(has_constraints.select("query_id", "has_constraints"), "query_id")
        .withColumns({"dense_score": F.coalesce("dense_score", F.lit(0.0)), "similarity": F.coalesce("similarity", F.lit(0.0))})
        .withColumn("score", F.round((1 - weight) * F.col("base_score") + weight * F.col("dense_score"), 9))
    )
    return rank_scored(rows, None, None, F.desc("dense_score"))
