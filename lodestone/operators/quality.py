"""Data quality of extracted attributes: audits, validation, evidence repair, name aliases, latest-record logic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.canonical import folded, parse_response, source_slices, surface

# Fields and limits of an extraction.
CORE_FIELDS = ("material", "color", "size_fit", "style", "use_case")
FIELDS = (*CORE_FIELDS, "specific_attributes")
CORE_LIMIT = 3
SPECIFIC_LIMIT = 5
EVIDENCE_CHARS = 80
SUBJECTIVE_NAMES = ("comfort", "durability", "quality", "reliability", "long_term_value", "value_for_money")
SUBJECTIVE_VALUES = ("beautiful", "comfortable", "durable", "good value", "high quality", "premium", "reliable")
# Rejection reasons, in the order in which they are tried; the marked ones can be repaired.
NOT_OBJECT = "entry is not a JSON object"
NO_VALUE = "value is not a non-empty string"
NO_EVIDENCE = "evidence is not a non-empty string"
LONG_EVIDENCE = "evidence exceeds 80 characters"
VALUE_NOT_IN_EVIDENCE = "value is not an exact substring of evidence"
EVIDENCE_NOT_IN_SOURCE = "evidence is not an exact substring of the supplied product data"
SUBJECTIVE_VALUE = "value is a disallowed subjective judgment"
BAD_NAME = "name is not lowercase snake_case"
SUBJECTIVE_NAME = "name is a disallowed subjective attribute"
OVER_LIMIT = "entry exceeds field limit"
DUPLICATE = "duplicate entry"
REPAIRABLE = (EVIDENCE_NOT_IN_SOURCE, LONG_EVIDENCE, VALUE_NOT_IN_EVIDENCE, NO_EVIDENCE)
# Names that mean the same attribute.
NAME_ALIASES = {
    "closure_type": "closure",
    "closure_system": "closure",
    "insole_cushioning": "cushioning",
    "footbed_cushioning": "cushioning",
    "midsole_cushioning": "cushioning",
    "cushioning_system": "cushioning",
    "cushioning_technology": "cushioning",
    "non_slip": "slip_resistance",
    "anti_slip": "slip_resistance",
    "slip_resistant": "slip_resistance",
    "nonslip": "slip_resistance",
    "water_protection": "water_resistance",
    "waterproof": "water_resistance",
    "water_repellent": "water_resistance",
    "water_repellency": "water_resistance",
    "water_proof": "water_resistance",
    "water_resistant": "water_resistance",
    "waterproofing": "water_resistance",
}
# Detail keys that are no evidence, and the length limits of the evidence document.
IGNORED_DETAILS = (
    "best sellers rank", "date first available", "is discontinued by manufacturer", "item model number",
    "package dimensions", "package weight", "shipping weight",
)
TITLE_CHARS, FEATURE_CHARS, DESCRIPTION_CHARS, DETAIL_CHARS = 500, 300, 800, 300
FEATURES_KEPT, DESCRIPTIONS_KEPT = 10, 2


def id_set_audit(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """How many ids each side has that the other lacks, in one pass over both."""
    sides = left.select("id", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select("id", F.lit(0).alias("l"), F.lit(1).alias("r")))
    per_id = sides.groupBy("id").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    counts = per_id.agg(
        F.coalesce(F.sum(((F.col("l") == 1) & (F.col("r") == 0)).cast("bigint")), F.lit(0)).alias("a"),
        F.coalesce(F.sum(((F.col("l") == 0) & (F.col("r") == 1)).cast("bigint")), F.lit(0)).alias("b"))
    return counts.select(F.inline(F.array(
        F.struct(F.lit(left_name).alias("audit"), F.col("a").alias("ids")), F.struct(F.lit(right_name).alias("audit"), F.col("b").alias("ids")))))


def checked_same_ids(left: DataFrame, right: DataFrame, what: str) -> None:
    """Error unless both sides hold exactly the same ids."""
    missing = {r["audit"]: r["ids"] for r in id_set_audit(left, right, "left", "right").collect()}
    if any(missing.values()):
        raise ValueError(f"{what}: {missing['left']} ids only on the left, {missing['right']} only on the right")


def complete_join(catalog: DataFrame, attributes: DataFrame) -> DataFrame:
    """Catalog beside attributes, after checking that neither side lacks a product or repeats one."""
    ids = lambda df: df.select(F.col("parent_asin").alias("id"))
    checked_same_ids(ids(catalog), ids(attributes), "catalog and attributes")
    repeated = attributes.groupBy("parent_asin").agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"attributes repeat product {repeated[0]['parent_asin']}")
    return catalog.join(attributes, "parent_asin")


# ---------------------------------------------------------------- evidence documents


def evidence_document(catalog: DataFrame) -> DataFrame:
    """Compact product text that may serve as evidence (length and count limits are part of the contract)."""
    cut = lambda c, n: F.transform(c, lambda v: F.substring(v, 1, n))
    none = F.array().cast("array<string>")
    details = F.map_filter(
        F.transform_values("details", lambda k, v: F.substring(v, 1, DETAIL_CHARS)),
        lambda k, v: v.isNotNull() & (v != "") & ~F.lower(k).isin(*IGNORED_DETAILS))
    return catalog.select(
        "parent_asin", F.substring(X.plain("title"), 1, TITLE_CHARS).alias("title"), F.coalesce("categories", none).alias("categories"),
        cut(F.slice(F.coalesce("features", none), 1, FEATURES_KEPT), FEATURE_CHARS).alias("features"),
        cut(F.slice(F.coalesce("description", none), 1, DESCRIPTIONS_KEPT), DESCRIPTION_CHARS).alias("description"),
        F.coalesce(details, F.create_map().cast("map<string,string>")).alias("details"))


def source_fragments(documents: DataFrame) -> DataFrame:
    """All leaf texts of each evidence document, as given and folded."""
    leaves = F.filter(
        F.concat(F.array("title"), "categories", "features", "description", F.map_values("details")), lambda v: v.isNotNull() & (v != ""))
    separated = documents.select("parent_asin", leaves.alias("fragments"))
    # One folding pass per product: fragments are joined by a separator that no text contains.
    joined = surface(F.array_join(F.transform("fragments", lambda v: F.regexp_replace(v, "\u0001", " ")), "\u0001"))
    return separated.select("parent_asin", "fragments", F.transform(F.split(joined, "\u0001"), lambda v: F.trim(v)).alias("surfaces"))


def passages(catalog: DataFrame, attributes: DataFrame) -> DataFrame:
    """Text passage of each product for an encoder; a product without any text is an error.

    ``attributes``: parent_asin, attributes map<field, array<struct<name, value, evidence>>>.
    """
    joined = complete_join(catalog, attributes)
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    filled = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    none = F.array().cast("array<string>")
    listed = F.filter(F.transform(F.coalesce("categories", none), strip), lambda v: v != "")
    specific = F.filter(
        F.transform(F.element_at("attributes", F.lit("specific_attributes")), lambda e: F.struct(strip(e["name"]).alias("n"), strip(e["value"]).alias("v"))),
        lambda e: (F.coalesce(e["n"], F.lit("")) != "") & (F.coalesce(e["v"], F.lit("")) != ""))
    parts = [
        filled("title", strip(X.plain("title"))), filled("category", F.array_join(listed, " > ")), filled("brand", strip(X.plain("store"))),
        filled("department", strip(F.element_at("details", F.lit("Department")))),
        *[filled(f, strip(F.try_element_at(F.element_at("attributes", F.lit(f)), F.lit(1))["value"])) for f in CORE_FIELDS],
        filled("specific attributes", F.array_join(F.transform(specific, lambda e: F.concat(e["n"], F.lit(": "), e["v"])), "; ")),
    ]
    text = F.array_join(F.array_compact(F.array(*parts)), "\n")
    return joined.select("parent_asin", F.when(text != "", text).otherwise(F.raise_error(
        F.concat(F.lit("no text for product "), F.col("parent_asin")))).alias("text"))


# ---------------------------------------------------------------- validation


def parsed_responses(responses: DataFrame) -> DataFrame:
    """Model responses with their usable JSON object, the kind of repair, or the reason they cannot be used."""
    parsed = responses.withColumn("_p", parse_response("raw_response"))
    usable = F.col("_p.json").isNotNull()
    return parsed.withColumns({
        "json": F.col("_p.json"), "repair_kind": F.when(usable, F.col("_p.kind")), "error": F.when(~usable, F.col("_p.kind"))}).drop("_p")


def _limit() -> Column:
    return F.when(F.col("field") == "specific_attributes", SPECIFIC_LIMIT).otherwise(CORE_LIMIT)


def _text_of(entry: Column, key: str) -> Column:
    """String member of a variant object; null when absent or of another type."""
    member = F.try_variant_get(entry, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(member) == "STRING", F.try_variant_get(entry, f"$.{key}", "string"))


def _entry_reason() -> Column:
    """First rule an entry breaks; null for a good one.  Reads value, evidence, name, surfaces and their folded forms."""
    blank = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s", " ")), F.lit("")) == ""
    specific = F.col("field") == "specific_attributes"
    return (
        F.when(~F.col("is_object"), NOT_OBJECT)
        .when(blank(F.col("value")), NO_VALUE)
        .when(blank(F.col("evidence")), NO_EVIDENCE)
        .when(F.length(F.trim("evidence")) > EVIDENCE_CHARS, LONG_EVIDENCE)
        .when(~F.col("evidence_folded").contains(F.col("value_folded")), VALUE_NOT_IN_EVIDENCE)
        .when(~F.exists("surfaces", lambda s: s.contains(F.col("evidence_folded"))), EVIDENCE_NOT_IN_SOURCE)
        .when(F.col("value_folded").isin(*SUBJECTIVE_VALUES), SUBJECTIVE_VALUE)
        .when(specific & ~F.coalesce(F.col("name").rlike(r"^[a-z][a-z0-9_]{0,63}$"), F.lit(False)), BAD_NAME)
        .when(specific & F.col("name").isin(*SUBJECTIVE_NAMES), SUBJECTIVE_NAME)
    )


def _judged(entries: DataFrame, fragments: DataFrame) -> DataFrame:
    folded_entries = entries.withColumns({"value_folded": surface("value"), "evidence_folded": surface("evidence")})
    return folded_entries.join(fragments.select("parent_asin", "surfaces"), "parent_asin", "left").withColumn(
        "surfaces", F.coalesce("surfaces", F.array().cast("array<string>"))).withColumn("reason", _entry_reason()).drop("surfaces")


def extraction_entries(responses: DataFrame) -> DataFrame:
    """One row per entry of each known field.  ``responses``: parent_asin, json."""
    root = responses.select("parent_asin", F.try_parse_json("json").alias("root"))
    lists = [F.struct(F.lit(f).alias("field"), F.try_variant_get("root", f"$.{f}", "array<variant>").alias("entries")) for f in FIELDS]
    rows = root.select("parent_asin", F.inline(F.array(*lists))).select("parent_asin", "field", F.posexplode("entries").alias("index", "entry"))
    return rows.select(
        "parent_asin", "field", "index", F.schema_of_variant("entry").startswith("OBJECT").alias("is_object"),
        _text_of(F.col("entry"), "value").alias("value"), _text_of(F.col("entry"), "evidence").alias("evidence"),
        _text_of(F.col("entry"), "name").alias("name"))


def validate_extractions(responses: DataFrame, documents: DataFrame) -> DataFrame:
    """Every entry with the reason it is rejected, or null: field, index, name, value, evidence, reason.

    Texts of accepted entries are trimmed.  Of equal accepted entries of a field the first stays.
    """
    judged = _judged(extraction_entries(responses), source_fragments(documents))
    judged = judged.withColumn("reason", F.when(F.col("index") >= _limit(), OVER_LIMIT).otherwise(F.col("reason")))
    name_part = F.when(F.col("field") == "specific_attributes", F.col("name")).otherwise("")
    same = Window.partitionBy("parent_asin", "field", name_part, "value_folded", "evidence_folded", F.col("reason").isNull()).orderBy("index")
    judged = judged.withColumn("_n", F.row_number().over(same)).withColumn(
        "reason", F.when(F.col("reason").isNull() & (F.col("_n") > 1), DUPLICATE).otherwise(F.col("reason")))
    trimmed = lambda c: F.when(F.col("reason").isNull(), F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).otherwise(F.col(c))
    return judged.select("parent_asin", "field", "index", "name", trimmed("value").alias("value"), trimmed("evidence").alias("evidence"), "reason")


def extraction_schema_errors(responses: DataFrame) -> DataFrame:
    """Errors in the shape of a response: unknown root fields, fields that are no arrays, arrays over their limit."""
    root = responses.select("parent_asin", F.try_parse_json("json").alias("root"))
    keys = F.map_keys(F.try_variant_get("root", "$", "map<string,variant>"))
    unknown = F.array_sort(F.array_except(keys, F.array(*[F.lit(f) for f in FIELDS])))
    errors = [F.when(F.size(unknown) > 0, F.concat(F.lit("unexpected root fields: "), F.array_join(unknown, ", ")))]
    for f in FIELDS:
        entries = F.try_variant_get("root", f"$.{f}", "array<variant>")
        limit = SPECIFIC_LIMIT if f == "specific_attributes" else CORE_LIMIT
        errors += [F.when(entries.isNull(), f"{f} must be an array"), F.when(F.size(entries) > limit, f"{f} exceeds the {limit}-entry limit")]
    return root.select("parent_asin", F.explode(F.array_compact(F.array(*errors))).alias("error"))


# ---------------------------------------------------------------- repair and names


def _same_value() -> Column:
    return F.concat_ws("\u0001", F.coalesce("name", F.lit("")), folded("value"))


def repair_evidence(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """Accepted entries plus rejected ones whose value is found word for word in the product's own text.

    Rejected entries are tried in their order; each field has room for its limit, and an entry whose name and value
    are already there is left out.  ``repaired`` marks what was added.
    """
    fragments = source_fragments(documents)
    accepted = entries.filter("reason is null").select("parent_asin", "field", "index", "name", "value", "evidence")
    broken = entries.filter(F.col("reason").isin(*REPAIRABLE) & F.col("value").isNotNull())
    # Only values that occur in the folded text at all go on to the exact search.
    likely = broken.withColumn("_v", surface("value")).join(fragments, "parent_asin").filter(
        (F.col("_v") != "") & F.exists("surfaces", lambda s: s.contains(F.col("_v"))))
    found = likely.withColumn("evidence", source_slices("value", "fragments")).filter("evidence is not null")
    found = found.select("parent_asin", "field", "index", "name", "value", "evidence", F.lit(True).alias("is_object"))
    good = _judged(found.filter(F.length("evidence") <= EVIDENCE_CHARS), fragments).filter("reason is null").select(
        "parent_asin", "field", "index", "name", F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("value"), "evidence")
    good = good.withColumn("name", F.when(F.col("field") == "specific_attributes", F.col("name")))
    both = accepted.withColumn("repaired", F.lit(False)).unionByName(good.withColumn("repaired", F.lit(True)))
    keyed = both.withColumn("_key", _same_value())
    # Accepted entries come first; equal repaired ones and those without room fall away.
    first = Window.partitionBy("parent_asin", "field", "_key").orderBy("repaired", "index")
    unique = keyed.withColumn("_n", F.row_number().over(first)).filter((F.col("_n") == 1) | ~F.col("repaired"))
    room = Window.partitionBy("parent_asin", "field").orderBy("repaired", "index")
    return unique.withColumn("position", F.row_number().over(room)).filter(~F.col("repaired") | (F.col("position") <= _limit())).select(
        "parent_asin", "field", "position", "name", "value", "evidence", "repaired")


def normalize_names(entries: DataFrame) -> DataFrame:
    """Specific attributes under their common names; entries made equal by that are marked ``dropped``."""
    names = F.create_map(*[F.lit(x) for pair in NAME_ALIASES.items() for x in pair])
    specific = F.col("field") == "specific_attributes"
    renamed = entries.withColumn("_old", F.col("name")).withColumn(
        "name", F.when(specific, F.coalesce(F.element_at(names, F.col("name")), F.col("name"))).otherwise(F.col("name")))
    keyed = renamed.withColumn("_key", _same_value())
    first = Window.partitionBy("parent_asin", "field", "_key").orderBy("position")
    numbered = keyed.withColumn("_n", F.row_number().over(first))
    return numbered.select(
        "parent_asin", "field", "position", "name", "value", "evidence", "repaired",
        (specific & ~F.col("_old").eqNullSafe(F.col("name"))).alias("aliased"), (specific & (F.col("_n") > 1)).alias("dropped"))


def nest_attributes(entries: DataFrame) -> DataFrame:
    """Entries back in one row per product: attributes map<field, array<struct<name, value, evidence>>>."""
    ordered = entries.groupBy("parent_asin", "field").agg(F.array_sort(F.collect_list(F.struct("position", "name", "value", "evidence"))).alias("e"))
    bare = F.transform("e", lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), x["evidence"].alias("evidence")))
    return ordered.groupBy("parent_asin").agg(F.map_from_entries(F.collect_list(F.struct("field", bare))).alias("attributes"))


def primary_values(attributes: DataFrame) -> DataFrame:
    """First value of each core field and of each specific name: parent_asin, field, name, value."""
    rows = attributes.select("parent_asin", F.explode("attributes").alias("field", "entries")).select(
        "parent_asin", "field", F.posexplode("entries").alias("pos", "e"))
    rows = rows.select("parent_asin", "field", "pos", F.when(F.col("field") == "specific_attributes", F.col("e.name")).alias("name"), F.col("e.value").alias("value"))
    core = F.col("field").isin(*CORE_FIELDS) & (F.col("pos") == 0)
    specific = (F.col("field") == "specific_attributes") & F.col("name").isNotNull()
    return rows.filter((core | specific) & (F.coalesce("value", F.lit("")) != "")).groupBy("parent_asin", "field", "name").agg(
        F.min_by("value", "pos").alias("value"))


# ---------------------------------------------------------------- runs


def latest_records(records: DataFrame) -> DataFrame:
    """Latest record of every product by ``seq``."""
    columns = [c for c in records.columns if c != "parent_asin"]
    return records.groupBy("parent_asin").agg(F.max_by(F.struct(*columns), "seq").alias("r")).select("parent_asin", "r.*")


def latest_successes(records: DataFrame) -> DataFrame:
    """Latest records, which must all be successes."""
    latest = latest_records(records)
    failures = latest.filter(~F.col("status").eqNullSafe("success")).count()
    if failures:
        raise ValueError(f"{failures} products have no successful latest extraction")
    return latest


def run_status(records: DataFrame) -> DataFrame:
    """Per product: whether any record succeeded (which sticks) and the status of the latest one."""
    return records.groupBy("parent_asin").agg(
        F.bool_or(F.col("status") == "success").alias("completed"), F.max_by("status", "seq").alias("latest_status"))


def unfinished(catalog: DataFrame, records: DataFrame, limit: int | None = None) -> DataFrame:
    """Products still to process; ``limit`` is the size asked for by one run."""
    done = records.filter("status = 'success'").select("parent_asin").distinct()
    rest = catalog.join(done, "parent_asin", "left_anti")
    return rest.orderBy("parent_asin").limit(limit) if limit is not None else rest


def usage_totals(records: DataFrame) -> DataFrame:
    """Token totals over all records, absent usage counting as zero."""
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(c)
    return records.select("usage.*").agg(total("prompt_tokens"), total("completion_tokens")).withColumn(
        "total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def run_summary(catalog: DataFrame, records: DataFrame) -> DataFrame:
    """Products, successes, remaining and products whose latest record is an error without any success."""
    joined = catalog.select("parent_asin").join(run_status(records), "parent_asin", "left")
    done = F.coalesce("completed", F.lit(False))
    count = lambda test: F.sum(test.cast("bigint"))
    return joined.agg(
        F.count("*").alias("catalog_products"), count(done).alias("successful_products"), count(~done).alias("remaining_products"),
        count(~done & F.col("latest_status").eqNullSafe("error")).alias("error_products"))


def recovered_responses(records: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, schema errors) from the kept texts of latest failed records that can be parsed after all."""
    failed = latest_records(records).filter("status = 'error' and raw_response is not null")
    usable = parsed_responses(failed).filter("json is not null").select("parent_asin", "json", "repair_kind")
    return validate_extractions(usable, documents), extraction_schema_errors(usable)


def checked_experiment(stored: dict | None, expected: dict) -> None:
    """A resumed run must have been started with the same settings."""
    if stored is None:
        raise ValueError("the extraction has no metadata header")
    different = sorted(k for k in {*stored, *expected} if stored.get(k) != expected.get(k))
    if different:
        raise ValueError(f"extraction settings differ: {', '.join(different)}")


def postprocess(entries: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(final entries, one row of totals): evidence repair, then common names, then removal of duplicates."""
    named = normalize_names(repair_evidence(entries, documents))
    totals = named.agg(
        F.count_distinct("parent_asin").alias("products"), F.coalesce(F.sum(F.col("repaired").cast("bigint")), F.lit(0)).alias("evidence_repairs"),
        F.coalesce(F.sum(F.col("aliased").cast("bigint")), F.lit(0)).alias("aliased_names"),
        F.coalesce(F.sum(F.col("dropped").cast("bigint")), F.lit(0)).alias("duplicates_removed"))
    return named.filter(~F.col("dropped")).drop("dropped"), totals
