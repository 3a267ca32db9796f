"""Prepared inputs shared by the registered queries: indexes, product rows, opening queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import messages as M
from lodestone.functions import text as X
from lodestone.operators import retrieval as R
from lodestone.operators.search_index import SearchIndex, build_index
from lodestone.plans.registry import built_once
from lodestone.session import write_table
from lodestone.sources import adapters as A
from lodestone.sources import catalog as C


def doc_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    return built_once(spark, sf_dir, "doc_index", build=lambda: build_index(A.document_catalog(spark, sf_dir)))


def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as products, written once: index, product rows and slots read it, and sales are summed up a single time."""
    def build() -> DataFrame:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return write_table(A.part_catalog(spark, sf_dir).repartition(tasks, "parent_asin"), "part_catalog")

    return built_once(spark, sf_dir, "part_catalog", build=build)


def part_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    return built_once(spark, sf_dir, "part_index", build=lambda: build_index(part_catalog(spark, sf_dir), drop_generic=True))


def part_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built_once(spark, sf_dir, "part_products", build=lambda: write_table(C.products(part_catalog(spark, sf_dir)), "products"))


def part_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built_once(spark, sf_dir, "part_stats", build=lambda: write_table(C.catalog_stats(part_products(spark, sf_dir)), "stats"))


def message_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.user_messages(spark, sf_dir).select(
        F.concat_ws(":", "session_id", F.col("turn").cast("string")).alias("query_id"), F.col("message").alias("query_text"))


def session_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's parsed first message, its target and the id of its query."""
    parsed = A.shopping_turns(spark, sf_dir).filter("turn = 1").select("session_id", "target", M.parse_opening("message").alias("p"))
    budget = M.budget_of("constraint")
    return parsed.select("session_id", "target", "p.*").select(
        "session_id", "target", "intent", "category", "constraint", "hard",
        F.concat_ws("|", "intent", "category", F.coalesce("constraint", F.lit(""))).alias("query_id"),
        F.when(F.col("constraint").isNull(), F.array().cast("array<string>")).otherwise(F.array("constraint")).alias("constraints"),
        budget.alias("budget_max"), F.when(budget.isNotNull(), F.col("hard")).alias("budget_hard"))


def opening_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct query contexts: many sessions open with the same request, which is then ranked once."""
    def build() -> DataFrame:
        distinct = session_openings(spark, sf_dir).groupBy("query_id").agg(*[
            F.first(c).alias(c) for c in ("intent", "category", "constraints", "budget_max", "budget_hard")])
        return write_table(distinct.withColumn("query_text", X.query_text("category", "constraints")), "opening_queries")

    return built_once(spark, sf_dir, "opening_queries", build=build)


def opening_candidates(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Candidates of the opening queries: products of their category, and lexical hits outside of it."""
    return R.candidate_parts(opening_lexical(spark, sf_dir), opening_queries(spark, sf_dir), part_products(spark, sf_dir))


def opening_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical route of every opening query."""
    def build() -> DataFrame:
        return write_table(R.bm25_topk(part_index(spark, sf_dir), opening_queries(spark, sf_dir)), "lexical")

    return built_once(spark, sf_dir, "opening_lexical", build=build)
