"""Catalog profiles: taxonomy, missing fields, distributions, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import vocab as V
from lodestone.session import write_table

# Fractions of the percentile summary.
FRACTIONS = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}
# Patterns of factual evidence in product text.
EVIDENCE_PATTERNS = {
    "cushioning": r"\b(?:cushion(?:ed|ing)?|memory foam|foam footbed|shock absor(?:b|bing|ption))\b",
    "breathability": r"\b(?:breathable|ventilat(?:ed|ion)|mesh upper|moisture[- ]wicking)\b",
    "stretch_flexibility": r"\b(?:stretch(?:y)?|flexib(?:le|ility)|elastic(?:ated)?)\b",
    "support": r"\b(?:arch support|ankle support|supportive|orthotic|stability)\b",
    "reinforced_construction": (
        r"\b(?:reinforced|double[- ]stitched|triple[- ]stitched|ripstop|abrasion[- ]resistant|heavy[- ]duty)\b"),
    "water_protection": r"\b(?:waterproof|water[- ]resistant|water resistant|water resistance)\b",
    "weather_insulation": r"\b(?:insulated|thermal|fleece[- ]lined|windproof|snowproof)\b",
    "sun_protection": r"\b(?:uv400|uv protection|sun protection|upf\s*\d+)\b",
    "closure": (
        r"\b(?:zipper|zip closure|button closure|lace[- ]up|hook[- ]and[- ]loop|buckle|drawstring|snap closure|slip[- ]on)\b"),
    "pockets": r"\b(?:pocket|pockets)\b",
    "personalization": r"\b(?:personalized|custom(?:ized)?|engraved|engraving|monogram(?:med)?|name necklace)\b",
    "gemstone": (
        r"\b(?:diamond|cubic zirconia|zirconia|ruby|sapphire|emerald|opal|pearl|amethyst|turquoise|moissanite|birthstone)\b"),
    "gemstone_spec": (
        r"\b(?:carat|clarity|lab[- ](?:grown|created)|natural (?:diamond|gemstone|stone)|treated|untreated|conflict[- ]free)\b"),
    "watch_movement": r"\b(?:quartz movement|automatic movement|mechanical movement|self[- ]winding|chronograph)\b",
    "watch_resistance": r"\b(?:water resistant to \d+|water resistance depth|\d+\s*(?:atm|meters?) water)\b",
    "metal": (
        r"\b(?:sterling silver|stainless steel|yellow gold|white gold|rose gold|platinum|titanium|brass|alloy|"
        r"gold[- ]plated|silver[- ]plated)\b"),
    "care": r"\b(?:machine wash(?:able)?|hand wash|dry clean|tumble dry)\b",
}
# Detail keys that speak about the same thing.
DETAIL_GROUPS = {
    "department": ("Department", "Suggested Users"),
    "brand": ("Brand", "Brand Name", "Manufacturer"),
    "color": ("Color",),
    "material": ("Material", "Material Type", "Fabric Type", "Outer Material", "Inner Material", "Metal Type"),
    "size": ("Size",),
    "style": ("Style", "Fit Type", "Pattern", "Neck Style", "Sleeve Type", "Closure Type"),
    "use_case": ("Sport", "Sport Type", "Occasion", "Theme"),
    "special_feature": ("Special Feature", "Special Features"),
}


def path_counts(catalog: DataFrame) -> DataFrame:
    """Products per distinct category path.  Everything about the taxonomy follows from this small table."""
    path = F.transform("categories", lambda v: F.trim(v))
    return catalog.groupBy(path.alias("path")).agg(F.count("*").alias("products"))


def taxonomy_levels(paths: DataFrame) -> DataFrame:
    """Distinct labels and distinct path prefixes per depth, with the number of products reaching that depth."""
    nodes = paths.filter(F.size("path") > 0).select("path", "products", F.posexplode("path").alias("i", "label")).select(
        (F.col("i") + 1).alias("depth"), "label", F.slice("path", 1, F.col("i") + 1).alias("node"), "products")
    return nodes.groupBy("depth").agg(
        F.count_distinct("label").alias("unique_labels"), F.count_distinct("node").alias("unique_nodes"),
        F.sum("products").alias("products"))


def taxonomy_summary(paths: DataFrame) -> DataFrame:
    """One row: products, products without categories, nodes, and the finest and second-finest levels."""
    full = paths.withColumn("depth", F.greatest(F.coalesce(F.size("path"), F.lit(0)), F.lit(0)))
    deep = F.col("depth") > 0
    nodes = full.filter(deep).select(F.explode(F.transform(F.sequence(F.lit(1), F.col("depth")), lambda n: F.slice("path", 1, n))).alias("node"))
    summary = full.agg(
        F.sum("products").alias("products"),
        F.sum(F.when(~deep, F.col("products")).otherwise(0)).alias("products_without_categories"),
        F.count_distinct(F.when(deep, F.element_at("path", -1))).alias("leaf_labels"),
        F.count_distinct(F.when(deep, F.col("path"))).alias("leaf_nodes"),
        F.count_distinct(F.when(F.col("depth") >= 2, F.try_element_at("path", F.lit(-2)))).alias("penultimate_labels"),
        F.count_distinct(F.when(F.col("depth") >= 2, F.slice("path", F.lit(1), F.col("depth") - 1))).alias("penultimate_nodes"))
    return summary.crossJoin(nodes.agg(F.count_distinct("node").alias("taxonomy_nodes")))


def depth_histogram(paths: DataFrame) -> DataFrame:
    return paths.filter(F.size("path") > 0).groupBy(F.size("path").alias("depth")).agg(F.sum("products").alias("products"))


def top_labels(paths: DataFrame, top: int = 10) -> DataFrame:
    """Most common labels of every level; equal counts fall to the smaller label."""
    if top <= 0:
        raise ValueError("top must be positive")
    labels = paths.filter(F.size("path") > 0).select("products", F.posexplode("path").alias("i", "label")).groupBy(
        (F.col("i") + 1).alias("depth"), "label").agg(F.sum("products").alias("products"))
    order = Window.partitionBy("depth").orderBy(F.desc("products"), F.asc("label"))
    return labels.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def department_audit(paths: DataFrame) -> DataFrame:
    """How far the second level consists of shopper departments."""
    second = paths.filter(F.size("path") >= 2).select(F.element_at("path", 2).alias("label"), "products")
    known = F.col("label").isin(*V.DEPARTMENT_LABELS)
    audit = second.agg(
        F.coalesce(F.sum("products"), F.lit(0)).alias("with_second_level"),
        F.coalesce(F.sum(F.when(known, F.col("products"))), F.lit(0)).alias("department_products"),
        F.count_distinct(F.when(~known, F.col("label"))).alias("other_labels"))
    return audit.withColumns({
        "department_fraction": F.when(
            F.col("with_second_level") > 0, F.round(F.col("department_products") / F.col("with_second_level"), 9)).otherwise(0.0),
        "always_department": F.col("other_labels") == 0,
    })


def field_missingness(df: DataFrame) -> DataFrame:
    """Per column: rows, missing values (null, empty text, empty list, empty map) and the type of the others."""
    aggregates, kinds = [F.count("*").alias("rows")], {}
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        missing = c.isNull()
        if kind == "string":
            missing = missing | (c == "")
        elif kind in ("array", "map"):
            missing = missing | (F.size(c) == 0)
        aggregates.append(F.sum(F.when(missing, 1).otherwise(0)).alias(f.name))
        kinds[f.name] = kind
    one = df.agg(*aggregates)
    entries = [F.struct(F.lit(n).alias("field"), F.col(n).alias("missing"), F.lit(k).alias("type")) for n, k in kinds.items()]
    return one.select("rows", F.inline(F.array(*entries))).withColumn("present", F.col("rows") - F.col("missing"))


def nearest_rank_summary(values: DataFrame) -> DataFrame:
    """Count, mean, extremes and nearest-rank percentiles per measure, exact at any size.

    ``values``: measure, value.  The rank of fraction f is round-half-even(f * (n - 1)).  Equal values are counted
    first, so a value that fills a third of the rows is one row.  Distinct values are then cut into ranges at
    sampled quantiles; running counts are made within a range, so no task sees more than a small part of a measure.
    """
    counted = values.filter("value is not null").groupBy("measure", "value").agg(F.count("*").alias("n"))
    # Counts and cuts are written once: ranges, offsets and ranks read the same ones.
    counted = write_table(counted, "counted")
    totals = counted.groupBy("measure").agg(
        F.sum("n").alias("count"), F.sum(F.col("n") * F.col("value")).alias("total"), F.min("value").alias("min"), F.max("value").alias("max"))
    cuts = write_table(counted.groupBy("measure").agg(F.percentile_approx("value", [i / 256 for i in range(1, 256)], 4096).alias("cuts")), "cuts")
    ranged = counted.join(F.broadcast(cuts), "measure").withColumn(
        "range", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    per_range = ranged.groupBy("measure", "range").agg(F.sum("n").alias("range_n"))
    before = Window.partitionBy("measure").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select("measure", "range", F.coalesce(F.sum("range_n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("measure", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.join(F.broadcast(offsets), ["measure", "range"]).withColumn("upto", F.col("offset") + F.sum("n").over(inside))
    ranked = ranked.join(F.broadcast(totals), "measure")
    position = {name: F.bround(f * (F.col("count") - 1)).cast("bigint") for name, f in FRACTIONS.items()}
    pick = {
        name: F.max(F.when((F.col("upto") > p) & (F.col("upto") - F.col("n") <= p), F.col("value"))).alias(name)
        for name, p in position.items()}
    return ranked.groupBy("measure").agg(
        F.first("count").alias("count"), F.round(F.first("total") / F.first("count"), 3).alias("mean"), F.first("min").alias("min"),
        *pick.values(), F.first("max").alias("max"))


def text_lengths(catalog: DataFrame) -> DataFrame:
    """(measure, value): characters of each text field of each product."""
    fields = {
        "title": X.plain("title"), "features": X.join_list("features"), "details": X.join_map("details"),
        "description": X.join_list("description"), "categories": X.join_list("categories"), "store": X.plain("store"),
    }
    return catalog.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("measure"), F.length(v).cast("double").alias("value")) for k, v in fields.items()])))


def detail_key_coverage(catalog: DataFrame) -> DataFrame:
    """Products per (category group, detail key) with a value, and their share of the group."""
    grouped = catalog.select(X.category_group("categories").alias("category_group"), "details")
    sizes = grouped.groupBy("category_group").agg(F.count("*").alias("group_products"))
    keys = grouped.select("category_group", F.explode("details").alias("key", "value")).filter("value is not null and value <> ''")
    return keys.groupBy("category_group", "key").agg(F.count("*").alias("products")).join(F.broadcast(sizes), "category_group").select(
        "category_group", "key", "products", F.round(F.col("products") / F.col("group_products"), 9).alias("share"))


def detail_group_coverage(catalog: DataFrame, top: int = 8) -> DataFrame:
    """Per detail group: covered products, distinct values and place of the most common ones."""
    registry = catalog.sparkSession.createDataFrame(
        [(g, k) for g, ks in DETAIL_GROUPS.items() for k in ks], "detail_group string, key string")
    entries = catalog.select("parent_asin", F.explode("details").alias("key", "raw")).filter("raw is not null and raw <> ''").join(
        F.broadcast(registry), "key").select("parent_asin", "detail_group", F.lower(F.trim("raw")).alias("value"))
    counts = entries.groupBy("detail_group", "value").agg(F.count("*").alias("n"))
    covered = entries.groupBy("detail_group").agg(F.count_distinct("parent_asin").alias("covered"))
    order = Window.partitionBy("detail_group").orderBy(F.desc("n"), F.asc("value"))
    distinct = counts.groupBy("detail_group").agg(F.count("*").alias("distinct_values"))
    best = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    return best.join(covered, "detail_group").join(distinct, "detail_group")


def evidence_counts(catalog: DataFrame) -> DataFrame:
    """Products per category group whose text shows each kind of factual evidence; one pass over the text."""
    entries = F.array_join(X.flatten_map("details"), " ")
    text = F.concat_ws(" ", X.plain("title"), X.join_list("features"), X.join_list("description"), entries)
    rows = catalog.select(X.category_group("categories").alias("category_group"), text.alias("text"))
    wide = rows.groupBy("category_group").agg(*[
        F.sum(F.col("text").rlike("(?iU)" + p).cast("int")).alias(name) for name, p in EVIDENCE_PATTERNS.items()])
    return wide.select("category_group", F.inline(F.array(*[
        F.struct(F.lit(n).alias("evidence"), F.col(n).alias("products")) for n in EVIDENCE_PATTERNS])))


def category_cardinality(catalog: DataFrame) -> DataFrame:
    """Distinct full paths, leaves and coarse categories."""
    keys = catalog.select("categories", F.element_at("categories", -1).alias("leaf"), X.coarse_category("categories").alias("coarse"))
    small = keys.groupBy("categories", "leaf", "coarse").agg(F.count("*").alias("n"))
    return small.agg(
        F.count_distinct("categories").alias("paths"), F.count_distinct("leaf").alias("leaves"), F.count_distinct("coarse").alias("coarse"))


def pool_sizes(catalog: DataFrame, targets: DataFrame) -> DataFrame:
    """(measure, value): how many products share the target's path, leaf and coarse category."""
    keys = catalog.select(
        "parent_asin", F.array_join("categories", "\u0001").alias("full_path"), F.element_at("categories", -1).alias("leaf"),
        X.normalized(X.coarse_category("categories")).alias("coarse"))
    wanted = keys.join(targets.select("parent_asin"), "parent_asin")
    parts = []
    for name in ("full_path", "leaf", "coarse"):
        sizes = keys.groupBy(name).agg(F.count("*").cast("double").alias("value"))
        parts.append(wanted.join(sizes, name).select(F.lit(name).alias("measure"), "value"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def price_coverage_by_leaf(catalog: DataFrame, top: int = 20) -> DataFrame:
    """Share of usable prices in the largest leaf categories."""
    per = catalog.groupBy(F.element_at("categories", -1).alias("leaf")).agg(
        F.count("*").alias("products"), F.sum(X.price_number("price").isNotNull().cast("int")).alias("priced"))
    return per.orderBy(F.desc("products"), F.asc("leaf")).limit(top).withColumn("share", F.round(F.col("priced") / F.col("products"), 9))


def price_kinds(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy(X.price_kind("price").alias("kind")).agg(F.count("*").alias("products"))


def population_measures(catalog: DataFrame, targets: DataFrame) -> DataFrame:
    """(measure, value) of ratings, rating counts and prices for the whole catalog and for the targets."""
    marked = catalog.join(targets.select("parent_asin").distinct().withColumn("target", F.lit(True)), "parent_asin", "left")
    base = {"average_rating": F.col("average_rating"), "rating_number": F.col("rating_number").cast("double"), "price": X.price_number("price")}
    entries = [F.struct(F.lit(f"catalog.{k}").alias("measure"), v.alias("value")) for k, v in base.items()]
    entries += [F.struct(F.lit(f"targets.{k}").alias("measure"), F.when(F.col("target"), v).alias("value")) for k, v in base.items()]
    return marked.select(F.inline(F.array(*entries))).filter("value is not null")


def document_statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """Mean, largest and total characters and words of a text column."""
    words = F.size(F.filter(F.split(F.col(text), r"(?U)\s+"), lambda w: w != ""))
    one = documents.select(F.length(text).alias("chars"), words.alias("words"))
    return one.agg(
        F.count("*").alias("documents"), F.round(F.avg("chars"), 2).alias("mean_chars"), F.max("chars").alias("max_chars"),
        F.sum("chars").alias("total_chars"), F.round(F.avg("words"), 2).alias("mean_words"), F.max("words").alias("max_words"),
        F.sum("words").alias("total_words"))
