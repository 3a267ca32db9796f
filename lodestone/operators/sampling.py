"""Samples, splits and session sets that do not depend on partitioning.

Uniform numbers come from a digest of seed and id, so every run and every cluster draws the same sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import vocab as V
from lodestone.session import write_table

RANGES = 256


def uniform(seed: int, *columns: str | Column) -> Column:
    """Uniform number in (0, 1) from seed and values."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def exact_rank(df: DataFrame, key: str, tie: str, groups: tuple[str, ...] = (), name: str = "position") -> DataFrame:
    """1-based rank by (key, tie), overall or within groups, without one task ever ordering a whole group.

    Rows are cut into ranges at sampled quantiles of the key; ranks inside a range add to the sizes of the
    ranges before it.  Keys are continuous here, so ranges come out even.
    """
    group_list = list(groups)
    # Written once: ranges and offsets read the same cuts even where a task is computed again.
    cuts = write_table(df.groupBy(*group_list).agg(F.percentile_approx(key, [i / RANGES for i in range(1, RANGES)], 4096).alias("_cuts")), "cuts")
    with_cuts = df.join(cuts, group_list) if group_list else df.crossJoin(F.broadcast(cuts))
    ranged = with_cuts.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(key)))).drop("_cuts")
    sizes = ranged.groupBy(*group_list, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(group_list or [F.lit(1)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group_list, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group_list, "_range").orderBy(key, tie)
    return ranged.join(offsets if group_list else F.broadcast(offsets), [*group_list, "_range"]).withColumn(
        name, (F.row_number().over(inside) + F.col("_before")).cast("bigint")).drop("_range", "_before")


def record_groups(purchases: DataFrame, catalog: DataFrame, excluded: DataFrame) -> DataFrame:
    """Purchase records of catalog products that are not excluded."""
    missing = {"parent_asin", "rating", "history"} - set(purchases.columns)
    if missing:
        raise ValueError(f"purchase records lack the columns {sorted(missing)}")
    return purchases.join(catalog.select("parent_asin"), "parent_asin", "left_semi").join(
        excluded.select("parent_asin"), "parent_asin", "left_anti")


def weighted_sample(records: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` distinct products, drawn without replacement with weight = number of records (exponential race)."""
    weights = records.groupBy("parent_asin").agg(F.count("*").alias("weight"))
    raced = weights.withColumn("race", -F.log(uniform(seed, "parent_asin")) / F.col("weight"))
    drawn = raced.orderBy("race", "parent_asin").limit(n)
    order = Window.orderBy("race", "parent_asin")  # over the n drawn rows
    return drawn.select("parent_asin", "weight", F.row_number().over(order).cast("bigint").alias("position"))


def checked_sample_size(records: DataFrame, n: int) -> None:
    available = records.select("parent_asin").distinct().limit(n).count()
    if n <= 0 or available < n:
        raise ValueError(f"{n} unique products asked for, {available} are eligible")


def scenario_quotas(n: int, shares: dict[str, float] | None = None) -> list[tuple[str, int]]:
    """Largest-remainder apportionment; ties go to the larger share."""
    shares = shares or V.SCENARIO_SHARES
    floors = {s: int(n * p) for s, p in shares.items()}
    left = n - sum(floors.values())
    by_remainder = sorted(shares, key=lambda s: (n * shares[s] - floors[s], shares[s]), reverse=True)
    for scenario in by_remainder[:left]:
        floors[scenario] += 1
    return list(floors.items())


def assign_scenarios(spark: SparkSession, selected: DataFrame, n: int, seed: int) -> DataFrame:
    """Scenario labels in exact quotas, in hash order."""
    start, spans = 0, []
    for scenario, count in scenario_quotas(n):
        spans.append((scenario, V.SCENARIO_DIFFICULTY[scenario], start + 1, start + count))
        start += count
    table = F.broadcast(spark.createDataFrame(spans, "scenario_type string, difficulty_bucket string, low bigint, high bigint"))
    shuffled = exact_rank(selected.withColumn("_u", uniform(seed, "parent_asin", F.lit("scenario"))), "_u", "parent_asin", name="_place")
    return shuffled.join(table, (F.col("_place") >= F.col("low")) & (F.col("_place") <= F.col("high"))).drop("_u", "_place", "low", "high")


def group_balanced_sample(catalog: DataFrame, per_group: int, leaf_cap: int, seed: int) -> DataFrame:
    """At most ``leaf_cap`` products of a category path, then ``per_group`` of each group."""
    path = F.when(F.size("categories") > 0, F.array_join("categories", "\u0001")).otherwise("unknown")
    rows = catalog.select("parent_asin", X.category_group("categories").alias("category_group"), path.alias("path"),
                          uniform(seed, "parent_asin").alias("u"))
    leaf = Window.partitionBy("path").orderBy("u", "parent_asin")
    capped = rows.withColumn("leaf_rank", F.row_number().over(leaf)).filter(F.col("leaf_rank") <= leaf_cap)
    group = Window.partitionBy("category_group").orderBy("u", "parent_asin")
    return capped.withColumn("group_rank", F.row_number().over(group)).filter(F.col("group_rank") <= per_group).select(
        "parent_asin", "category_group", "path", "leaf_rank", "group_rank")


def checked_group_sample(sample: DataFrame, per_group: int, groups=("clothing", "shoes", "jewelry")) -> DataFrame:
    sizes = {r["category_group"]: r["n"] for r in sample.groupBy("category_group").agg(F.count("*").alias("n")).collect()}
    for group in groups:
        if sizes.get(group, 0) < per_group:
            raise ValueError(f"only {sizes.get(group, 0)} {group} products are eligible, {per_group} are needed")
    return sample


def session_samples(records: DataFrame, catalog: DataFrame, tag_templates: DataFrame, n: int, seed: int) -> DataFrame:
    """Sessions for ``n`` sampled products: scenario, buckets and a profile from one of the product's records.

    ``tag_templates``: template_no 0..m-1, preference_tags; a small table of profile templates.
    """
    spark = records.sparkSession
    templates = tag_templates.count()
    if templates == 0:
        raise ValueError("at least one profile template is needed")
    selected = assign_scenarios(spark, weighted_sample(records, n, seed), n, seed)
    record = F.struct("rating", F.coalesce("history", F.lit("")).alias("history"))
    order = uniform(seed, "parent_asin", F.col("user_id"), F.col("rating").cast("string"), F.coalesce("history", F.lit("")))
    chosen = records.groupBy("parent_asin").agg(F.min_by(record, F.struct(order.alias("u"), record.alias("r"))).alias("r"))
    template_no = F.floor(uniform(seed, "parent_asin", F.lit("tags")) * templates).cast("bigint")
    rows = (
        selected.join(chosen, "parent_asin").join(catalog.select("parent_asin", X.category_group("categories").alias("category_bucket")), "parent_asin")
        .withColumn("template_no", template_no).join(F.broadcast(tag_templates), "template_no")
    )
    style = X.rating_style("r.rating")
    tags = F.when(F.size("preference_tags") > 0, F.array_join("preference_tags", ", ")).otherwise("general shopping")
    return rows.select(
        F.format_string("generated_%04d", "position").alias("sample_id"), "scenario_type", "category_bucket", "difficulty_bucket",
        F.struct("parent_asin").alias("ground_truth"),
        F.struct(
            X.purchase_frequency("r.history").alias("purchase_frequency"), F.col("r.rating").alias("average_prior_rating"),
            style.alias("rating_style"), F.col("preference_tags"),
            F.concat(F.lit("Prior purchases emphasize "), tags, F.lit("; ratings are "), style, F.lit(".")).alias("summary"),
        ).alias("user_profile"))


def sample_distributions(samples: DataFrame) -> DataFrame:
    """Counts by category, scenario, rating style and preference tag, in one long table."""
    named = lambda kind, c: F.array(F.struct(F.lit(kind).alias("distribution"), c.alias("label")))
    tags = F.transform("user_profile.preference_tags", lambda t: F.struct(F.lit("preference_tag").alias("distribution"), t.alias("label")))
    entries = F.concat(
        named("category", F.col("category_bucket")), named("scenario", F.col("scenario_type")),
        named("rating_style", F.col("user_profile.rating_style")), tags)
    return samples.select(F.inline(entries)).groupBy("distribution", "label").agg(F.count("*").alias("samples"))


def stratified_split(products: DataFrame, stratum: str, seed: int, shares: dict[str, float] | None = None) -> DataFrame:
    """Disjoint train / validation / test split with the same shares in every stratum."""
    shares = shares or {"train": 0.70, "validation": 0.15, "test": 0.15}
    rows = exact_rank(products.withColumn("_u", uniform(seed, "parent_asin")), "_u", "parent_asin", (stratum,), "_place")
    sizes = products.groupBy(stratum).agg(F.count("*").alias("_size"))
    position = (F.col("_place") - 0.5) / F.col("_size")
    rule, upper = None, 0.0
    for name, share in list(shares.items())[:-1]:
        upper += share
        rule = F.when(position < upper, name) if rule is None else rule.when(position < upper, name)
    rule = rule.otherwise(list(shares)[-1]) if rule is not None else F.lit(next(iter(shares)))
    return rows.join(F.broadcast(sizes), stratum).withColumn("split", rule).drop("_u", "_place", "_size")


def balanced_targets(products: DataFrame, sessions: int, seed: int) -> DataFrame:
    """``sessions`` targets over the products so that use counts differ by at most one."""
    count = products.count()
    ranked = exact_rank(products.select("parent_asin", uniform(seed, "parent_asin").alias("_u")), "_u", "parent_asin", name="_place")
    uses = F.lit(sessions // count) + F.when(F.col("_place") <= sessions % count, 1).otherwise(0)
    return ranked.withColumn("uses", uses).filter("uses > 0").select(
        "parent_asin", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("repeat_no"))


def unique_first_sessions(samples: DataFrame, limit: int, seed: int) -> DataFrame:
    """``limit`` sessions, one per product before any product repeats.  ``samples``: sample_id, target."""
    keyed = samples.withColumn("u", uniform(seed, "sample_id"))
    per_target = Window.partitionBy("target").orderBy("u", "sample_id")
    # A target's repeat beyond the limit can never be chosen, which lets Spark cut hot targets early.
    rounds = keyed.withColumn("repeat_no", F.row_number().over(per_target)).filter(F.col("repeat_no") <= limit)
    ordered = exact_rank(rounds.withColumn("_key", F.col("repeat_no") + F.col("u")), "_key", "sample_id")
    return ordered.filter(F.col("position") <= limit).select("sample_id", "target", "repeat_no", "position")


def constraint_cards(catalog: DataFrame, limit: int = 180) -> DataFrame:
    """Constraint card of each product: two hard constraints and up to two soft preferences."""
    corpus = X.searchable_text()
    base = catalog.select("parent_asin", "title", "features", "details", "price", corpus.alias("corpus"))
    material, color = X.first_material("corpus"), X.first_color("corpus")
    flat = F.concat(X.flatten_list("features"), X.flatten_map("details"))
    color_entry = F.concat(F.lit("color: "), color)
    empty = F.array().cast("array<string>")
    # With no material, the color goes in behind the first flattened entry.
    head = (
        F.when(material.isNotNull() & color.isNotNull(), F.concat(F.array(material, color_entry), F.col("flat")))
        .when(material.isNotNull(), F.concat(F.array(material), F.col("flat")))
        .when(color.isNotNull(), F.concat(
            F.slice("flat", 1, 1), F.array(color_entry), F.when(F.size("flat") > 1, F.slice("flat", F.lit(2), F.size("flat") - 1)).otherwise(empty)))
        .otherwise(F.col("flat"))
    )
    budget = F.when(F.col("price").isNotNull() & (F.col("price") != ""), F.array(F.concat(F.lit("budget around $"), F.col("price")))).otherwise(empty)
    cleaned = F.array_distinct(F.filter(
        F.transform(F.concat(head, budget), lambda v: X.clean_constraint(v, limit)), lambda v: v != ""))
    title = X.clean_constraint(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("product")), limit)
    card = base.withColumn("flat", flat).select("parent_asin", title.alias("target_category"), cleaned.alias("cleaned"))
    card = card.withColumn("cleaned", F.when(F.size("cleaned") == 0, F.array("target_category")).otherwise(F.col("cleaned")))
    return card.select(
        "parent_asin", "target_category", F.slice("cleaned", 1, 2).alias("hard_constraints"),
        F.when(F.size("cleaned") > 2, F.slice("cleaned", 3, 2)).otherwise(F.slice("cleaned", 1, 1)).alias("soft_preferences"))


def constraint_type_distribution(cards: DataFrame) -> DataFrame:
    """Constraint types over cards: hard, soft, first hard, any, and how many distinct types a card has."""
    kinds = lambda c: F.transform(c, X.classify_constraint)
    rows = cards.select(kinds("hard_constraints").alias("hard"), kinds("soft_preferences").alias("soft"))
    entry = lambda kind, label: F.struct(F.lit(kind).alias("distribution"), label.alias("label"))
    every = F.array_distinct(F.concat("hard", "soft"))
    entries = F.concat(
        F.transform("hard", lambda k: entry("hard", k)), F.transform("soft", lambda k: entry("soft", k)),
        F.transform(F.slice("hard", 1, 1), lambda k: entry("first_hard", k)), F.transform(every, lambda k: entry("any", k)),
        F.array(entry("distinct_types", F.size(every).cast("string"))))
    return rows.select(F.inline(entries)).groupBy("distribution", "label").agg(F.count("*").alias("cards"))
