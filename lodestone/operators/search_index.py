"""Full-text index tables: postings, document lengths and term statistics."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import vocab as V
from lodestone.operators.blockmax import BlockIndex, build_blocks
from lodestone.session import shared_dir


TASK_CHARS = 16_000_000  # text that one task splits and counts


@dataclass(frozen=True)
class SearchIndex:
    postings: DataFrame    # term, parent_asin, wtf (field-weighted frequency), doc_len
    documents: DataFrame   # parent_asin, doc_len
    term_stats: DataFrame  # term, df, idf
    totals: DataFrame      # one row: doc_count, avg_len
    blocks: BlockIndex     # the same postings by term and product range, with block maxima


def indexed_fields(catalog: DataFrame, drop_generic: bool = False) -> DataFrame:
    """The six indexed text fields; ``drop_generic`` leaves umbrella categories out."""
    categories = X.specific_categories("categories") if drop_generic else F.col("categories")
    return catalog.select(
        "parent_asin",
        X.plain("title").alias("title"), X.join_list(categories).alias("categories"), X.join_list("features").alias("features"),
        X.join_map("details").alias("details"), X.plain("store").alias("store"), X.join_list("description").alias("description"),
    )


def _with_weight(tokens: Column, weight: float) -> Column:
    return F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))


def text_tasks(catalog: DataFrame, drop_generic: bool = False) -> int:
    """Tasks among which the text is spread: as many as shuffles have, more when one would get over ``TASK_CHARS`` characters."""
    spark = catalog.sparkSession
    fields = indexed_fields(catalog, drop_generic)
    chars = fields.agg(F.sum(sum((F.coalesce(F.length(f), F.lit(0)) for f in V.BM25_FIELDS), F.lit(0)))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // TASK_CHARS))


def build_postings(
    catalog: DataFrame, drop_generic: bool = False, tokenizer: Callable[[Column], Column] = X.index_tokens,
    weights: dict[str, float] | None = None, buckets: int | None = None,
) -> DataFrame:
    """One row per (product, term).

    Rows are spread by product id once, as text.  Exploding and counting then need no further exchange, and one
    giant document can only load its own task.
    """
    weights = weights or V.BM25_WEIGHTS
    # A fixed number: adaptive execution would join small inputs of tasks whose terms then take many times their room.
    spread = catalog.repartition(buckets or text_tasks(catalog, drop_generic), "parent_asin")
    tokens = indexed_fields(spread, drop_generic).select(
        "parent_asin", *[tokenizer(F.col(f)).alias(f) for f in V.BM25_FIELDS])
    tagged = [_with_weight(F.col(f), weights[f]) for f in V.BM25_FIELDS]
    lengths = sum((F.size(f) for f in V.BM25_FIELDS), F.lit(0))
    return (
        tokens.select("parent_asin", lengths.alias("doc_len"), F.explode(F.concat(*tagged)).alias("t"))
        .groupBy("parent_asin", F.col("t.term").alias("term"))
        .agg(F.sum("t.w").alias("wtf"), F.first("doc_len").alias("doc_len"))
    )


def inverse_document_frequency(df: Column, doc_count: Column) -> Column:
    return F.greatest(F.log((doc_count - df + 0.5) / (df + 0.5)), F.lit(V.BM25_IDF_FLOOR))


def build_index(
    catalog: DataFrame, drop_generic: bool = False, tokenizer: Callable[[Column], Column] = X.index_tokens,
    buckets: int | None = None,
) -> SearchIndex:
    """Build the index as tables in the shared folder.

    Postings are bucketed by product id, so scoring sums per (query, product) without an exchange, and sorted by
    term inside each bucket, so a term filter can skip row groups.
    """
    spark = catalog.sparkSession
    buckets = buckets or text_tasks(catalog, drop_generic)
    folder = shared_dir(spark)
    name = f"postings_{uuid.uuid4().hex}"
    (
        build_postings(catalog, drop_generic, tokenizer, buckets=buckets)
        .write.bucketBy(buckets, "parent_asin").sortBy("term").option("path", f"{folder}/postings").format("parquet").saveAsTable(name)
    )
    postings = spark.table(name)
    sizes = indexed_fields(catalog, drop_generic).select(
        "parent_asin", sum((F.size(tokenizer(F.col(f))) for f in V.BM25_FIELDS), F.lit(0)).alias("doc_len"))
    sizes.write.parquet(f"{folder}/documents")
    documents = spark.read.parquet(f"{folder}/documents")
    totals = documents.agg(F.count("*").alias("doc_count"), F.avg("doc_len").alias("avg_len"))
    totals.write.parquet(f"{folder}/totals")
    totals = spark.read.parquet(f"{folder}/totals")
    stats = (
        postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(totals.select("doc_count")))
        .select("term", "df", inverse_document_frequency(F.col("df"), F.col("doc_count")).alias("idf"))
    )
    stats.write.parquet(f"{folder}/term_stats")
    blocks = build_blocks(postings, documents, totals, folder)
    return SearchIndex(postings, documents, spark.read.parquet(f"{folder}/term_stats"), totals, blocks)


def term_idf(index: SearchIndex, kind: str = "bm25") -> DataFrame:
    """Inverse document frequency under one of the three formulas in use."""
    stats = index.term_stats.crossJoin(F.broadcast(index.totals.select("doc_count")))
    n, df = F.col("doc_count"), F.col("df")
    formulas = {
        "bm25": inverse_document_frequency(df, n),
        "feature": F.log(1 + (n - df + 0.5) / (df + 0.5)),
        "ranker": F.log((n + 1) / (df + 1)) + 1,
    }
    return stats.select("term", "df", formulas[kind].alias("idf"))
