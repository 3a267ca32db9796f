"""Tree-ranker features, scoring and the guarded exchange at the last place of the first page."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import vocab as V
from lodestone.functions.canonical import canonical
from lodestone.operators.rerank import FIELD_GROUPS

# Routes with their cutoffs, constraint slots, query views.
ROUTE_CUTOFFS = {"coverage": 100, "p11": 10, "broad": 120, "strict": 80, "fused": 200, "structured": 10, "semantic": 10}
ROUTES = tuple(ROUTE_CUTOFFS)
CONSTRAINT_SLOTS = ("category", "material", "color", "size", "style", "brand", "price", "feature", "use_case")
QUERY_VIEWS = ("turn", "goal", "active")
LEXICAL = (
    "token_recall", "token_precision", "token_jaccard", "rare_term_coverage", "char3_overlap", "char4_overlap",
    "bigram_coverage", "trigram_coverage",
)
GLOBALS = (
    "hard_clause_coverage", "explicit_negative_violation", "missing_positive_evidence_fraction", "current_turn_override",
    "retired_goal_evidence_conflict", "price_missing", "active_constraint_count_fraction", "hard_constraint_count_fraction",
    "negative_constraint_count_fraction", "query_specificity_fraction", "goal_age_fraction", "goal_version_fraction",
    "override_count_fraction", "candidate_bayesian_rating_percentile", "candidate_popularity_percentile",
    "title_category_length_log", "features_details_length_log", "description_store_length_log",
)
HISTORY = (
    "previous_presence", "previous_rank_fraction", "previous_reciprocal_rank", "best_historical_rank_fraction", "rank_velocity",
    "turn_persistence_fraction", "p11_structured_top10_jaccard", "p11_semantic_top10_jaccard", "broad_strict_top10_jaccard",
    "coverage_fused_top10_jaccard", "mean_top10_route_jaccard", "top10_vote_entropy",
)
AGREEMENT = ("top10_route_agreement_fraction", "route_rank_mean", "route_rank_min", "route_rank_max", "route_rank_dispersion")
FEATURES = (
    "turn_fraction",
    *(f"{r}_{k}" for r in ROUTES for k in ("presence", "rank_fraction", "reciprocal_rank")),
    *AGREEMENT, *(f"{r}_incumbent_rr_margin" for r in ROUTES), *HISTORY,
    *(f"{v}_{k}" for v in QUERY_VIEWS for k in (*(f"{g}_idf_coverage" for g in FIELD_GROUPS), *LEXICAL)),
    *(f"{s}_{k}" for s in CONSTRAINT_SLOTS for k in ("observed", "compatible", "unknown", "conflict")),
    *GLOBALS,
)
GATE_FEATURES = (
    "ranker_margin", "ranker_top_gap", "challenger_score", "incumbent_score", "coverage_rank_fraction", "broad_presence",
    "strict_presence", "structured_presence", "semantic_presence", "top10_route_agreement_fraction", "route_rank_dispersion",
    "active_title_category_idf_coverage", "active_features_details_idf_coverage", "active_description_store_idf_coverage",
    "active_token_recall", "active_rare_term_coverage", "active_bigram_coverage", "hard_clause_coverage",
    "explicit_negative_violation", "missing_positive_evidence_fraction", "query_specificity_fraction", "goal_age_fraction",
    "challenger_minus_incumbent_active_recall", "challenger_minus_incumbent_hard_coverage",
    "challenger_minus_incumbent_conflict_sum",
)
FINGERPRINT = 2048
PAGE = 100


def single(c: Column) -> Column:
    """Rounded to single precision, as the model was trained."""
    return c.cast("float").cast("double")


# ---------------------------------------------------------------- query and product views


def ngram_positions(items: Column, n: int, glue: str) -> Column:
    """Distinct fingerprint positions of the n-grams of an array column; linear in its length."""
    joined = items
    for k in range(2, n + 1):
        joined = F.array_compact(F.zip_with(
            joined, F.slice(items, F.lit(k), F.greatest(F.size(items), F.lit(1))), lambda a, b: F.concat(a, F.lit(glue), b)))
    return F.array_distinct(F.transform(joined, lambda g: F.pmod(F.xxhash64(g), F.lit(FINGERPRINT)).cast("int")))


def product_fingerprints(fields: DataFrame) -> DataFrame:
    """Word sets, lengths and n-gram fingerprints of each product, from the field-group sequences."""
    tokens = F.filter(F.flatten(F.transform(
        F.concat(*[F.col(f"{g}_seq") for g in FIELD_GROUPS]), lambda s: F.split(s, " +"))), lambda t: t != "")
    staged = fields.select("parent_asin", *[F.col(f"{g}_set").alias(f"{g}_set") for g in FIELD_GROUPS], tokens.alias("tokens"))
    staged = staged.withColumn("chars", F.split(F.concat(F.lit(" "), canonical(F.array_join("tokens", " ")), F.lit(" ")), ""))
    return staged.select(
        "parent_asin", *[F.filter(f"{g}_set", lambda t: t != "").alias(f"{g}_set") for g in FIELD_GROUPS],
        F.array_distinct("tokens").alias("combined"), ngram_positions(F.col("chars"), 3, "").alias("char3"),
        ngram_positions(F.col("chars"), 4, "").alias("char4"), ngram_positions(F.col("tokens"), 2, "\u001f").alias("bigram"),
        ngram_positions(F.col("tokens"), 3, "\u001f").alias("trigram"))


def query_view(queries: DataFrame, terms: str, idf: DataFrame, default_idf: Column) -> DataFrame:
    """Term weights, rarest third and fingerprints of one view of each query (at most fifty distinct terms).

    ``queries``: query_id and an array column ``terms``; ``idf``: term, idf; ``default_idf`` for unknown terms.
    """
    listed = queries.select("query_id", F.slice(F.array_distinct(terms), 1, 50).alias("terms"))
    weighted = listed.select("query_id", F.explode("terms").alias("term")).join(idf.select("term", "idf"), "term", "left").withColumn(
        "idf", F.coalesce("idf", default_idf))
    per_query = weighted.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("k"), "term"))).alias("w"))
    rows = listed.join(per_query, "query_id", "left")
    rare = F.transform(F.slice("w", F.lit(1), F.ceil(F.size("w") / 3).cast("int")), lambda x: x["term"])
    none = F.array().cast("array<string>")
    staged = rows.select(
        "query_id", "terms", F.map_from_entries(F.transform("w", lambda x: F.struct(x["term"], -x["k"]))).alias("idf_of"),
        F.coalesce(F.aggregate("w", F.lit(0.0), lambda a, x: a - x["k"]), F.lit(0.0)).alias("idf_total"), F.coalesce(rare, none).alias("rare"),
        F.split(F.concat(F.lit(" "), canonical(F.array_join("terms", " ")), F.lit(" ")), "").alias("chars"))
    return staged.select(
        "query_id", "terms", "idf_of", "idf_total", "rare", ngram_positions(F.col("chars"), 3, "").alias("q_char3"),
        ngram_positions(F.col("chars"), 4, "").alias("q_char4"), ngram_positions(F.col("terms"), 2, "\u001f").alias("q_bigram"),
        ngram_positions(F.col("terms"), 3, "\u001f").alias("q_trigram"))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.when(F.size(whole) > 0, F.size(F.array_intersect(part, whole)) / F.size(whole)), F.lit(0.0))


def lexical_features(pairs: DataFrame, view: DataFrame, products: DataFrame, prefix: str) -> DataFrame:
    """Eleven lexical features of each (query, product) under one query view."""
    rows = pairs.select("query_id", "parent_asin").join(F.broadcast(view), "query_id").join(products, "parent_asin")
    weight = lambda field: F.aggregate(
        F.array_intersect("terms", field), F.lit(0.0), lambda a, t: a + F.element_at("idf_of", t))
    columns = {
        f"{g}_idf_coverage": F.coalesce(F.when(F.col("idf_total") > 0, weight(f"{g}_set") / F.col("idf_total")), F.lit(0.0))
        for g in FIELD_GROUPS}
    union = F.size(F.array_union("terms", "combined"))
    columns |= {
        "token_recall": _share(F.col("combined"), F.col("terms")), "token_precision": _share(F.col("terms"), F.col("combined")),
        "token_jaccard": F.when(union > 0, F.size(F.array_intersect("terms", "combined")) / union).otherwise(0.0),
        "rare_term_coverage": _share(F.col("combined"), F.col("rare")), "char3_overlap": _share(F.col("char3"), F.col("q_char3")),
        "char4_overlap": _share(F.col("char4"), F.col("q_char4")), "bigram_coverage": _share(F.col("bigram"), F.col("q_bigram")),
        "trigram_coverage": _share(F.col("trigram"), F.col("q_trigram")),
    }
    return rows.select("query_id", "parent_asin", *[c.alias(f"{prefix}_{n}") for n, c in columns.items()])


# ---------------------------------------------------------------- constraints


def slot_sets(slots: DataFrame) -> DataFrame:
    """Observed and inferred values per slot of each product, as two maps."""
    observed = F.col("source").isin("categories", "store", "details") | F.col("source").startswith("details.")
    per_slot = slots.groupBy("parent_asin", "slot").agg(
        F.collect_set(F.when(observed, F.col("value"))).alias("seen"), F.collect_set(F.when(~observed, F.col("value"))).alias("guessed"))
    return per_slot.groupBy("parent_asin").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "seen"))).alias("seen"),
        F.map_from_entries(F.collect_list(F.struct("slot", "guessed"))).alias("guessed"))


def query_constraints(ledger: DataFrame) -> DataFrame:
    """Active and retired ledger records of each query as arrays.  ``ledger``: query_id and record columns."""
    record = F.struct("slot", canonical("value").alias("value"), "polarity", "hardness")
    named = ledger.withColumn("record", record)
    return named.groupBy("query_id").agg(
        F.collect_list(F.when(F.col("status") == "active", F.col("record"))).alias("active"),
        F.collect_list(F.when(F.col("status") != "active", F.col("record"))).alias("retired"))


def constraint_features(rows: DataFrame) -> DataFrame:
    """36 slot features and 18 globals.

    ``rows`` carry: active, retired (``query_constraints``), seen, guessed (``slot_sets``), combined and field sets
    (``product_fingerprints``), price, budget_upper, hard_terms, query_terms, turn, version, anchor_turn, override,
    override_count, bayesian_rating_percentile, popularity_percentile.
    """
    none = F.array().cast("array<string>")
    records = "array<struct<slot:string,value:string,polarity:int,hardness:string>>"
    active, retired = F.coalesce("active", F.array().cast(records)), F.coalesce("retired", F.array().cast(records))
    spoken = lambda v: F.size(F.array_except(F.split(v, " "), F.col("combined"))) == 0
    values = lambda s, p: F.array_distinct(F.transform(
        F.filter(active, lambda r: (r["slot"] == s) & (r["polarity"] * p > 0) & (r["value"] != "")), lambda r: r["value"]))
    as_number = lambda test: F.when(test, 1.0).otherwise(0.0)
    out, missing, total, violation = {}, F.lit(0), F.lit(0), F.lit(False)
    for s in CONSTRAINT_SLOTS:
        if s == "price":
            asked, known = F.col("budget_upper").isNotNull(), F.col("price").isNotNull()
            out |= {
                "price_observed": as_number(asked & known), "price_compatible": as_number(asked & known & (F.col("price") <= F.col("budget_upper"))),
                "price_unknown": as_number(asked & ~known), "price_conflict": as_number(asked & known & (F.col("price") > F.col("budget_upper"))),
            }
            total, missing = total + asked.cast("int"), missing + (asked & ~known).cast("int")
            continue
        wanted, refused = values(s, 1), values(s, -1)
        seen, guessed = F.coalesce(F.element_at("seen", F.lit(s)), none), F.coalesce(F.element_at("guessed", F.lit(s)), none)
        either = F.array_union(seen, guessed)
        observed = F.arrays_overlap(wanted, seen)
        hit = F.arrays_overlap(refused, either)
        if s == "feature":
            observed, hit = observed | F.exists(wanted, spoken), hit | F.exists(refused, spoken)
        compatible = observed | F.arrays_overlap(wanted, guessed)
        has_slot, asks = F.size(either) > 0, F.size(wanted) > 0
        absent = _absent(wanted, either, spoken if s == "feature" else None)
        out |= {
            f"{s}_observed": as_number(observed), f"{s}_compatible": as_number(compatible),
            f"{s}_unknown": as_number(asks & ~has_slot & ~compatible), f"{s}_conflict": as_number(hit | (asks & has_slot & ~compatible)),
        }
        total, missing, violation = total + F.size(wanted), missing + F.size(absent), violation | hit
    held = lambda r: F.array_contains(F.coalesce(F.element_at("seen", r["slot"]), none), r["value"]) | F.array_contains(
        F.coalesce(F.element_at("guessed", r["slot"]), none), r["value"])
    hard = F.filter(active, lambda r: (r["hardness"] == "hard") & (r["polarity"] > 0))
    hard_hits = F.filter(hard, lambda r: held(r) | ((r["slot"] == "feature") & spoken(r["value"])))
    lexical_hard = _share(F.col("combined"), F.array_distinct("hard_terms"))
    capped = lambda c, top: F.least(c, F.lit(top)) / float(top)
    length = lambda g: F.log1p(F.size(f"{g}_set")) / F.log(F.lit(501.0))
    out |= {
        "hard_clause_coverage": F.when(F.size(hard) > 0, F.size(hard_hits) / F.size(hard)).otherwise(lexical_hard),
        "explicit_negative_violation": as_number(violation),
        "missing_positive_evidence_fraction": F.when(total > 0, missing / total).otherwise(0.0),
        "current_turn_override": as_number(F.col("override")),
        "retired_goal_evidence_conflict": as_number(
            F.exists(retired, lambda r: (r["polarity"] > 0) & held(r)) & ~F.exists(active, lambda r: (r["polarity"] > 0) & held(r))),
        "price_missing": as_number(F.col("price").isNull()),
        "active_constraint_count_fraction": capped(F.size(active), 20),
        "hard_constraint_count_fraction": capped(F.size(F.filter(active, lambda r: r["hardness"] == "hard")), 10),
        "negative_constraint_count_fraction": capped(F.size(F.filter(active, lambda r: r["polarity"] < 0)), 10),
        "query_specificity_fraction": capped(F.size("query_terms"), 50),
        "goal_age_fraction": capped(F.greatest(F.lit(1), F.col("turn") - F.col("anchor_turn") + 1), 10),
        "goal_version_fraction": capped(F.col("version"), 10), "override_count_fraction": capped(F.col("override_count"), 5),
        "candidate_bayesian_rating_percentile": F.coalesce("bayesian_rating_percentile", F.lit(0.0)),
        "candidate_popularity_percentile": F.coalesce("popularity_percentile", F.lit(0.0)),
        **{f"{g}_length_log": length(g) for g in FIELD_GROUPS},
    }
    return rows.select("query_id", "parent_asin", *[c.alias(n) for n, c in out.items()])


def _absent(wanted: Column, either: Column, spoken) -> Column:
    """Wanted values a product neither shows nor, for features, spells out."""
    if spoken is None:
        return F.array_except(wanted, either)
    return F.filter(F.array_except(wanted, either), lambda v: ~spoken(v))


# ---------------------------------------------------------------- routes and history


def route_features(page: DataFrame) -> DataFrame:
    """Route presence, agreement, margins to the incumbent, route overlaps and vote entropy.

    ``page``: query_id, parent_asin, one ``<route>_rank`` per route (null when absent), at most a hundred per query.
    """
    w = Window.partitionBy("query_id")
    rank = {r: F.col(f"{r}_rank") for r in ROUTES}
    inverse = {r: F.coalesce(1.0 / rank[r], F.lit(0.0)) for r in ROUTES}
    present = F.array_compact(F.array(*[single(rank[r] / ROUTE_CUTOFFS[r]) for r in ROUTES]))
    staged = page.withColumns({
        "votes": sum((F.coalesce((rank[r] <= 10).cast("int"), F.lit(0)) for r in ROUTES), F.lit(0)), "present": present,
        **{f"{r}_top": F.collect_set(F.when(rank[r] <= 10, F.col("parent_asin"))).over(w) for r in ROUTES},
        **{f"{r}_inc": F.max(F.when(F.col("p11_rank") == 10, inverse[r])).over(w) for r in ROUTES},
    })
    total = F.sum("votes").over(w)
    share = F.col("votes") / total
    staged = staged.withColumns({
        "vote_terms": F.sum(F.when(F.col("votes") > 0, -share * F.log(share)).otherwise(0.0)).over(w),
        "voted": F.sum((F.col("votes") > 0).cast("int")).over(w),
    })
    jaccard = lambda a, b: F.when(
        F.size(F.array_union(f"{a}_top", f"{b}_top")) > 0,
        F.size(F.array_intersect(f"{a}_top", f"{b}_top")) / F.size(F.array_union(f"{a}_top", f"{b}_top"))).otherwise(0.0)
    pairs = [(a, b) for i, a in enumerate(ROUTES) for b in ROUTES[i + 1:]]
    mean = F.aggregate("present", F.lit(0.0), lambda a, x: a + x) / F.size("present")
    out = {}
    for r in ROUTES:
        out |= {
            f"{r}_presence": F.when(rank[r].isNotNull(), 1.0).otherwise(0.0),
            f"{r}_rank_fraction": F.coalesce(rank[r] / ROUTE_CUTOFFS[r], F.lit(1.25)), f"{r}_reciprocal_rank": inverse[r],
            f"{r}_incumbent_rr_margin": inverse[r] - F.coalesce(f"{r}_inc", F.lit(0.0)),
        }
    some = F.size("present") > 0
    spread = F.sqrt(F.aggregate("present", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size("present"))
    out |= {
        "top10_route_agreement_fraction": F.col("votes") / len(ROUTES), "route_rank_mean": F.when(some, mean).otherwise(1.25),
        "route_rank_min": F.coalesce(F.array_min("present"), F.lit(1.25)), "route_rank_max": F.coalesce(F.array_max("present"), F.lit(1.25)),
        "route_rank_dispersion": F.when(some, spread).otherwise(0.0),
        "p11_structured_top10_jaccard": jaccard("p11", "structured"), "p11_semantic_top10_jaccard": jaccard("p11", "semantic"),
        "broad_strict_top10_jaccard": jaccard("broad", "strict"), "coverage_fused_top10_jaccard": jaccard("coverage", "fused"),
        "mean_top10_route_jaccard": sum((jaccard(a, b) for a, b in pairs), F.lit(0.0)) / len(pairs),
        "top10_vote_entropy": F.when(F.col("voted") > 1, F.col("vote_terms") / F.log(F.col("voted"))).otherwise(0.0),
    }
    return staged.select("query_id", "parent_asin", *[f"{r}_rank" for r in ROUTES], *[c.alias(n) for n, c in out.items()])


def history_features(rows: DataFrame) -> DataFrame:
    """Columns from ``rank_history``: previous_rank, best_rank, velocity, persistence (null on the first turn)."""
    return rows.withColumns({
        "previous_presence": F.when(F.col("previous_rank").isNotNull(), 1.0).otherwise(0.0),
        "previous_rank_fraction": F.coalesce(F.col("previous_rank") / PAGE, F.lit(1.25)),
        "previous_reciprocal_rank": F.coalesce(1.0 / F.col("previous_rank"), F.lit(0.0)),
        "best_historical_rank_fraction": F.coalesce(F.col("best_rank") / PAGE, F.lit(1.25)),
        "rank_velocity": F.coalesce("velocity", F.lit(0.0)), "turn_persistence_fraction": F.coalesce("persistence", F.lit(0.0)),
    }).drop("previous_rank", "best_rank", "velocity", "persistence")


def feature_rows(page: DataFrame, parts: list[DataFrame], turn: DataFrame) -> DataFrame:
    """The full feature row per (query, product) in single precision.  ``turn``: query_id, turn."""
    rows = page.join(turn.select("query_id", (F.col("turn") / V.MAX_TURNS).alias("turn_fraction")), "query_id")
    for part in parts:
        rows = rows.join(part, ["query_id", "parent_asin"])
    return rows.select("query_id", "parent_asin", *[f"{r}_rank" for r in ROUTES], *[single(F.col(f)).alias(f) for f in FEATURES])


# ---------------------------------------------------------------- model


def validate_trees(trees: list[Mapping], features: tuple[str, ...] = FEATURES) -> None:
    """A tree is five equally long lists: left, right, feature, value, default_left."""
    for tree in trees:
        sizes = {len(tree[k]) for k in ("left", "right", "feature", "value", "default_left")}
        if len(sizes) != 1 or not sizes.pop():
            raise ValueError("tree lists must be equally long and not empty")
        for node, (left, right, feature) in enumerate(zip(tree["left"], tree["right"], tree["feature"])):
            if left < 0:
                if right >= 0:
                    raise ValueError("a leaf has no children")
            elif not (node < left < len(tree["left"]) and node < right < len(tree["left"]) and 0 <= feature < len(features)):
                raise ValueError("split refers to an unknown node or feature")


def tree_column(tree: Mapping, features: tuple[str, ...] = FEATURES, node: int = 0) -> Column:
    """One tree as nested conditions; a missing value takes the default side."""
    left, right = tree["left"][node], tree["right"][node]
    if left < 0:
        return F.lit(float(tree["value"][node]))
    value = F.col(features[tree["feature"][node]])
    low, high = tree_column(tree, features, left), tree_column(tree, features, right)
    default = low if tree["default_left"][node] else high
    return F.when(value.isNull() | F.isnan(value), default).when(value < float(tree["value"][node]), low).otherwise(high)


def score_trees(rows: DataFrame, trees: list[Mapping], base_score: float, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Ensemble score, summed in single precision tree by tree."""
    validate_trees(trees, features)
    total = single(F.lit(float(base_score)))
    for tree in trees:
        total = single(total + tree_column(tree, features))
    return rows.withColumn("ranker_score", total)


def logistic(head: Mapping, values: Column) -> Column:
    """Probability of a standardized linear head: mean, scale, coef lists and an intercept, over an array column."""
    if not len(head["mean"]) == len(head["scale"]) == len(head["coef"]) or any(s <= 0 for s in head["scale"]):
        raise ValueError("head lists must be equally long and scales positive")
    linear = F.lit(float(head["intercept"]))
    for i, (m, s, c) in enumerate(zip(head["mean"], head["scale"], head["coef"])):
        linear = linear + F.lit(float(c)) * (F.element_at(values, i + 1) - F.lit(float(m))) / F.lit(float(s))
    return 1.0 / (1.0 + F.exp(-linear))


def choose_challenger(scored: DataFrame) -> DataFrame:
    """Best-scoring product outside ranks 1-9 against the incumbent at rank 10, with margins and gate inputs.

    Equal scores fall to the better coverage rank.  ``scored``: feature rows with p11_rank and ranker_score.
    """
    allowed = scored.filter((F.col("coverage_rank") > 10) | (F.col("p11_rank") == 10))
    columns = [c for c in scored.columns if c != "query_id"]
    order = Window.partitionBy("query_id").orderBy(F.desc("ranker_score"), F.asc("coverage_rank"))
    placed = allowed.withColumn("_place", F.row_number().over(order))
    row = F.struct(*columns)
    duel = placed.groupBy("query_id").agg(
        F.max(F.when(F.col("_place") == 1, row)).alias("c"), F.max(F.when(F.col("p11_rank") == 10, row)).alias("i"),
        F.max(F.when(F.col("_place") == 2, F.col("ranker_score"))).alias("second")).filter("c is not null and i is not null")
    margin = single(F.col("c.ranker_score") - F.col("i.ranker_score"))
    gap = single(F.col("c.ranker_score") - F.coalesce("second", F.col("c.ranker_score")))
    conflict = lambda side: sum((F.col(f"{side}.{s}_conflict") for s in CONSTRAINT_SLOTS), F.lit(0.0))
    gate = [margin, gap, F.col("c.ranker_score"), F.col("i.ranker_score"), *[F.col(f"c.{n}") for n in GATE_FEATURES[4:22]],
            F.col("c.active_token_recall") - F.col("i.active_token_recall"),
            F.col("c.hard_clause_coverage") - F.col("i.hard_clause_coverage"), conflict("c") - conflict("i")]
    return duel.select(
        "query_id", F.col("c.parent_asin").alias("challenger"), F.col("i.parent_asin").alias("incumbent"),
        margin.alias("margin"), gap.alias("top_gap"), F.array(*[single(g) for g in gate]).alias("gate"))


def admit(duels: DataFrame, rescue: Mapping, threshold: float, regret: Mapping | None = None, multiplier: float = 0.0) -> DataFrame:
    """Admit a challenger whose rescue probability, less weighted regret, reaches the threshold."""
    utility = logistic(rescue, F.col("gate"))
    if regret is not None:
        utility = utility - F.lit(float(multiplier)) * logistic(regret, F.col("gate"))
    admitted = (F.col("challenger") != F.col("incumbent")) & (F.col("utility") >= threshold)
    return duels.withColumn("utility", utility).withColumn("admitted", admitted).select(
        "query_id", F.when(F.col("admitted"), F.col("challenger")).alias("challenger"), "incumbent", "margin", "top_gap", "utility", "admitted")
