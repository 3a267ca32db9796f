"""Rank fusion and rank-preserving reorderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vocab as V
from lodestone.operators.retrieval import rank_within

# Reciprocal-rank fusion and pool sizes.
BROAD_OFFSET = 60
STRICT_OFFSET = 20
STRICT_WEIGHT = 1.8
NEGATIVE_POOL = 50
GRACE_PAGES = 2


def reciprocal_rank_fusion(broad: DataFrame, strict: DataFrame) -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked routes; ties by broad rank (absent last), then id."""
    tagged = broad.select("query_id", "parent_asin", F.col("rank").alias("b"), F.lit(None).cast("int").alias("s")).unionByName(
        strict.select("query_id", "parent_asin", F.lit(None).cast("int").alias("b"), F.col("rank").alias("s")))
    both = tagged.groupBy("query_id", "parent_asin").agg(F.max("b").alias("broad_rank"), F.max("s").alias("strict_rank"))
    score = F.coalesce(1.0 / (BROAD_OFFSET + F.col("broad_rank")), F.lit(0.0)) + F.coalesce(
        STRICT_WEIGHT / (STRICT_OFFSET + F.col("strict_rank")), F.lit(0.0))
    scored = both.withColumn("fusion_score", F.round(score, 12))
    return rank_within(scored, F.desc("fusion_score"), F.asc_nulls_last("broad_rank"), F.asc("parent_asin"), name="fused_rank")


def coverage_order(fused: DataFrame, query_terms: DataFrame, product_terms: DataFrame) -> DataFrame:
    """Order by how many distinct query terms a product shows, keeping the fused order among equals.

    ``query_terms``: query_id, terms; ``product_terms``: parent_asin, search_terms.
    """
    covered = (
        fused.join(query_terms.select("query_id", F.col("terms").alias("_q")), "query_id")
        .join(product_terms.select("parent_asin", F.col("search_terms").alias("_p")), "parent_asin", "left")
        .withColumn("coverage", F.coalesce(F.size(F.array_intersect("_q", "_p")), F.lit(0)))
        .drop("_q", "_p")
    )
    return rank_within(covered, F.desc("coverage"), F.asc("fused_rank"), name="coverage_rank")


def coverage_histogram(ordered: DataFrame) -> DataFrame:
    return ordered.groupBy("query_id", "coverage").agg(F.count("*").alias("candidates"))


def negative_partition(ranked: DataFrame, rank: str = "rank", pool: int = NEGATIVE_POOL) -> DataFrame:
    """Compatible, then unknown, then violating products inside the pool; the tail keeps its place.

    ``ranked`` carries ``state`` (compatible / unknown / explicit_violation).
    """
    bucket = F.when(F.col(rank) > pool, 0).otherwise(
        F.when(F.col("state") == "compatible", 0).when(F.col("state") == "unknown", 1).otherwise(2))
    return rank_within(ranked, (F.col(rank) > pool).cast("int").asc(), bucket.asc(), F.col(rank).asc(), name="partition_rank")


def violation_fallback(partitioned: DataFrame, rank: str = "rank", pool: int = NEGATIVE_POOL, k: int = V.TOP_K) -> DataFrame:
    """Counts per state inside the pool and how many violating products had to fill the first page."""
    inside = F.col(rank) <= pool
    count = lambda s: F.sum(F.when(inside & (F.col("state") == s), 1).otherwise(0))
    safe = count("compatible") + count("unknown")
    return partitioned.groupBy("query_id").agg(
        count("compatible").alias("compatible"), count("unknown").alias("unknown"),
        count("explicit_violation").alias("explicit_violation"),
        F.greatest(F.lit(0), F.least(F.lit(k), F.count("*")) - F.least(F.lit(k), safe)).alias("fallback"))


def paginate(ranked: DataFrame, served: DataFrame, rank: str = "rank") -> DataFrame:
    """Pages one and two as ranked; later pages put products not yet served first.

    ``ranked`` carries ``intent_age``; ``served`` holds (query_id, parent_asin) already shown under the same intent.
    """
    seen = served.select("query_id", "parent_asin").distinct().withColumn("seen", F.lit(1))
    marked = ranked.join(seen, ["query_id", "parent_asin"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    key: Column = F.when(F.col("intent_age") <= GRACE_PAGES, 0).otherwise(F.col("seen"))
    return rank_within(marked, key.asc(), F.col(rank).asc(), name="page_rank")


def swap_slot(ranked: DataFrame, swaps: DataFrame, slot: int = V.TOP_K, rank: str = "rank") -> DataFrame:
    """Exchange the challenger with the product at ``slot``; all other ranks stay.

    ``swaps``: query_id, challenger (null for no swap).
    """
    w = Window.partitionBy("query_id")
    joined = ranked.join(swaps.select("query_id", "challenger"), "query_id", "left")
    challenger_rank = F.max(F.when(F.col("parent_asin") == F.col("challenger"), F.col(rank))).over(w)
    return joined.withColumn("challenger_rank", challenger_rank).withColumn(
        "swapped_rank",
        F.when(F.col("challenger_rank").isNull() | (F.col("challenger_rank") <= slot), F.col(rank))
        .when(F.col("parent_asin") == F.col("challenger"), slot)
        .when(F.col(rank) == slot, F.col("challenger_rank"))
        .otherwise(F.col(rank)),
    ).drop("challenger_rank")
