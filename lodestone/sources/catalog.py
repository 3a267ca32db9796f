"""Catalog files to clean product rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as X
from lodestone.functions import vocab as V

CATALOG_SCHEMA = T.StructType([
    T.StructField("parent_asin", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("description", T.ArrayType(T.StringType())),
    T.StructField("price", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("details", T.MapType(T.StringType(), T.StringType())),
    T.StructField("average_rating", T.DoubleType()),
    T.StructField("rating_number", T.LongType()),
    T.StructField("store", T.StringType()),
])


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines catalog with a declared schema; blank lines are skipped, broken lines fail."""
    return spark.read.schema(CATALOG_SCHEMA).option("mode", "FAILFAST").json(path)


def catalog_id_violations(catalog: DataFrame) -> DataFrame:
    """Missing or repeated product ids, one row per violation."""
    ids = catalog.select(F.trim(F.col("parent_asin")).alias("parent_asin"))
    return (
        ids.groupBy("parent_asin").agg(F.count("*").alias("rows"))
        .withColumn(
            "violation",
            F.when(F.col("parent_asin").isNull() | (F.col("parent_asin") == ""), "missing parent_asin")
            .when(F.col("rows") > 1, "duplicate parent_asin"))
        .filter("violation is not null")
        .select("parent_asin", "rows", "violation")
    )


def checked_catalog(catalog: DataFrame) -> DataFrame:
    """The catalog, or an error naming the first violation."""
    bad = catalog_id_violations(catalog).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['violation']}: {bad[0]['parent_asin']} ({bad[0]['rows']} rows)")
    return catalog


def products(catalog: DataFrame) -> DataFrame:
    """Clean product rows with every derived column; one narrow pass over the catalog."""
    specific = X.specific_categories("categories")
    searchable = F.array_join(
        F.array(
            X.plain("title"), X.join_list("features"), X.join_map("details"), X.join_list("description"),
            X.join_list(specific), X.plain("store"),
        ), " ")
    base = catalog.select(
        "*", specific.alias("specific"), searchable.alias("searchable"), X.coarse_category("categories").alias("coarse_category"))
    return base.select(
        "parent_asin",
        X.plain("title").alias("title"),
        X.join_list("description").alias("description"),
        F.col("categories").alias("category_path"),
        "coarse_category",
        X.normalized("coarse_category").alias("category_key"),
        F.array_distinct(X.terms(X.join_list("specific"))).alias("category_terms"),
        F.array_distinct(X.terms("searchable")).alias("search_terms"),
        "average_rating",
        "rating_number",
        X.price_number("price").alias("price"),
        X.price_is_lower_bound("price").alias("price_is_lower_bound"),
        X.normalize_department(F.element_at("details", F.lit("Department"))).alias("department"),
        X.first_material("searchable").alias("material"),
        X.first_color("searchable").alias("color"),
        X.first_detail("details", V.STYLE_KEYS).alias("style"),
        X.first_detail("details", V.SIZE_KEYS).alias("size"),
        F.coalesce(X.first_detail("details", V.BRAND_KEYS), F.nullif(X.normalized(X.plain("store")), F.lit(""))).alias("brand"),
        X.first_detail("details", V.USE_CASE_KEYS).alias("use_case"),
        (F.size("features") > 0).alias("has_features"),
        X.category_group("categories").alias("category_group"),
        X.fine_category_group("categories").alias("fine_group"),
    )


def attribute_values(product_rows: DataFrame) -> DataFrame:
    """Logical question attributes as long rows (parent_asin, attribute, value); absent values give no row."""
    values = {
        "material": F.col("material"), "color": F.col("color"), "style": F.coalesce("department", "style"),
        "size": F.col("size"), "brand": F.col("brand"), "budget": X.price_band("price"), "use_case": F.col("use_case"),
        "feature": F.when(F.col("has_features"), "present"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("attribute"), v.alias("value")) for k, v in values.items()])
    return product_rows.select("parent_asin", F.inline(pairs)).filter("value is not null")


def catalog_stats(product_rows: DataFrame) -> DataFrame:
    """One row: mean rating, exact median rating count, largest rating count, product count."""
    return product_rows.agg(
        F.avg("average_rating").alias("mean_rating"),
        F.percentile("rating_number", F.lit(0.5)).alias("median_rating_number"),
        F.max("rating_number").alias("max_rating_number"),
        F.count("*").alias("product_count"),
    )


def group_per_category(product_rows: DataFrame) -> DataFrame:
    """Most common group of each coarse category; equal counts fall to the smaller label."""
    counts = product_rows.groupBy("category_key", "category_group").agg(F.count("*").alias("n"))
    best = F.min_by(F.struct("category_group", "n"), F.struct((-F.col("n")).alias("k"), F.col("category_group").alias("g")))
    return counts.groupBy("category_key").agg(best.alias("b")).select(
        "category_key", F.col("b.category_group").alias("category_group"), F.col("b.n").alias("products"))


def question_category(queries: DataFrame, product_rows: DataFrame) -> DataFrame:
    """Category group of each query's category text: the catalog's, else from head nouns."""
    keyed = queries.withColumn("category_key", X.normalized("category"))
    groups = group_per_category(product_rows).select("category_key", F.col("category_group").alias("known"))
    return keyed.join(groups, "category_key", "left").select(
        "query_id", "category", F.coalesce("known", X.head_noun_group("category")).alias("question_group"))
