"""Recommendation quality over recorded logs."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vocab as V
from lodestone.operators.scoring import ScoringConfig, blended_topk


def normalize_recommendations(rec_log: DataFrame, catalog: DataFrame, k: int = V.TOP_K) -> DataFrame:
    """First ``k`` distinct catalog products of each response, in order.

    ``rec_log``: session_id, turn, recommendations array<string>; ``catalog``: parent_asin.
    """
    shown = rec_log.select("session_id", "turn", F.posexplode("recommendations").alias("pos", "raw")).select(
        "session_id", "turn", "pos", F.trim("raw").alias("parent_asin")).filter("parent_asin <> ''")
    known = shown.join(catalog.select("parent_asin"), "parent_asin", "left_semi")
    first = known.groupBy("session_id", "turn", "parent_asin").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("session_id", "turn").orderBy("pos")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("pos")


def session_outcomes(normalized: DataFrame, labels: DataFrame) -> DataFrame:
    """First turn on which the target is among the recommendations, not before an override has taken place.

    ``labels``: session_id, scenario_type, target, override_turn (null when there is none).
    """
    hits = (
        normalized.join(labels.select("session_id", F.col("target").alias("parent_asin"), "override_turn"), ["session_id", "parent_asin"])
        .filter((F.col("turn") <= V.MAX_TURNS) & (F.col("turn") >= F.coalesce("override_turn", F.lit(1))))
        .groupBy("session_id").agg(F.min("turn").alias("first_hit_turn"), F.min_by("rank", "turn").alias("best_rank"))
    )
    return labels.select("session_id", "scenario_type").join(hits, "session_id", "left").select(
        "session_id", "scenario_type", F.col("first_hit_turn").isNotNull().alias("hit"), "first_hit_turn", "best_rank",
        F.coalesce(1.0 / F.col("best_rank"), F.lit(0.0)).alias("reciprocal_rank"))


def _metrics() -> list[Column]:
    return [
        F.count("*").alias("sample_count"),
        F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate_at_10"),
        F.round(F.avg("reciprocal_rank"), 6).alias("mrr"),
        F.round(F.avg(F.coalesce("first_hit_turn", F.lit(V.MAX_TURNS + 1))), 6).alias("mttc"),
    ]


def with_score(metrics: DataFrame) -> DataFrame:
    """Efficiency and composite score, from the rounded metrics."""
    efficiency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (11.0 - F.col("mttc")) / 10.0))
    return metrics.withColumn("efficiency", F.round(efficiency, 6)).withColumn(
        "score", F.round(0.50 * F.col("hit_rate_at_10") + 0.30 * F.col("mrr") + 0.20 * efficiency, 6))


def metric_summary(outcomes: DataFrame, *keys: str) -> DataFrame:
    return with_score(outcomes.groupBy(*keys).agg(*_metrics()))


def metric_report(outcomes: DataFrame) -> DataFrame:
    """Metrics per scenario and over all sessions (scenario ``all``)."""
    rolled = outcomes.rollup("scenario_type").agg(*_metrics())
    return with_score(rolled.withColumn("scenario_type", F.coalesce("scenario_type", F.lit("all"))))


def token_totals(usage: DataFrame) -> DataFrame:
    """Token totals over valid counts; negative or absent ones are left out."""
    valid = lambda c: F.coalesce(F.sum(F.when(F.col(c) >= 0, F.col(c))), F.lit(0)).cast("bigint")
    sums = usage.agg(valid("prompt_tokens").alias("prompt_tokens"), valid("completion_tokens").alias("completion_tokens"))
    return sums.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def session_objective(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Mean per-session objective: a hit earns 0.5 + 0.3 / rank + 0.2 x earliness, a miss nothing."""
    earned = 0.5 + 0.3 * F.col("reciprocal_rank") + 0.2 * (11 - F.col("first_hit_turn")) / 10.0
    return outcomes.groupBy(*keys).agg(F.round(F.avg(F.when(F.col("hit"), earned).otherwise(0.0)), 9).alias("objective"))


def sweep(
    lexical: DataFrame, queries: DataFrame, products: DataFrame, stats: DataFrame, configs: Mapping[str, ScoringConfig], labels: DataFrame,
) -> DataFrame:
    """Metrics of scoring configurations on the same candidates; place 1 is the best.

    Each configuration reads its best candidates alone, no more of a category than can matter.  ``labels``: query_id, target.
    """
    best = reduce(DataFrame.unionByName, [
        blended_topk(lexical, queries, products, stats, V.TOP_K, config).select(F.lit(name).alias("config_id"), "query_id", "parent_asin", "rank")
        for name, config in sorted(configs.items())])
    hits = best.join(
        labels.select("query_id", F.col("target").alias("parent_asin")).distinct(), ["query_id", "parent_asin"]).select(
        "config_id", "query_id", "parent_asin", "rank")
    grid = labels.select("query_id", F.col("target").alias("parent_asin"), F.explode(F.array(*[F.lit(name) for name in sorted(configs)])).alias("config_id"))
    outcomes = grid.join(hits, ["config_id", "query_id", "parent_asin"], "left").select(
        "config_id", F.col("rank").isNotNull().alias("hit"), F.when(F.col("rank").isNotNull(), 1).alias("first_hit_turn"),
        F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("reciprocal_rank"))
    summary = metric_summary(outcomes, "config_id")
    # One row per configuration: ranking them needs no more than one small partition.
    placed = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), F.asc("config_id"))
    return summary.withColumn("place", F.row_number().over(placed))


def split_leaks(samples: DataFrame) -> DataFrame:
    """Targets that occur in more than one split, with the splits' names.  ``samples``: split, target."""
    return samples.groupBy("target").agg(F.array_sort(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1).select(
        "target", F.array_join("splits", " and ").alias("splits"))


def checked_splits(samples: DataFrame) -> DataFrame:
    leak = split_leaks(samples).orderBy("target").limit(1).collect()
    if leak:
        raise ValueError(f"target {leak[0]['target']} occurs in {leak[0]['splits']}")
    return samples


def run_signature(samples: DataFrame) -> DataFrame:
    """Signature of the selected sessions: equal for equal sets of (split, sample_id), independent of order.

    Ids are digested one by one and summed per split, so no list of ids is ever built.
    """
    part = lambda start: F.conv(F.substring(F.md5("sample_id"), start, 12), 16, 10).cast("decimal(38,0)")
    sums = samples.groupBy("split").agg(F.count("*").alias("n"), F.sum(part(1)).alias("a"), F.sum(part(13)).alias("b"))
    line = F.concat_ws(":", "split", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))
    return sums.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("signature"))
