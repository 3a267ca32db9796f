"""Turn updates produced by an outside parser: shape and range rules as columns, bad rows set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X

# Keys, groups, tags and limits of an update.
KEYS = (
    "browsing_probability", "end_conversation", "category_action", "category_query", "catalog_group", "constraints_to_add",
    "constraint_ids_to_remove", "no_preference_facets", "profile",
)
GROUPS = ("clothing", "shoes", "jewelry", "other", "unknown")
TAGS = ("material", "style", "fit", "weather", "warmth", "performance", "comfort", "durability", "feature")
TEXT_CHARS = 160
MESSAGE_CHARS = 500


def _clean(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^[ .]+|[ .]+$", "")


def _kind(path: str) -> Column:
    return F.regexp_extract(F.coalesce(F.schema_of_variant(F.try_variant_get("p", path, "variant")), F.lit("VOID")), "^[A-Z]+", 0)


def turn_updates(payloads: DataFrame) -> DataFrame:
    """Parsed update with its list of errors.  ``payloads``: session_id, turn, payload (JSON text)."""
    keep = [c for c in payloads.columns if c != "payload"]
    rows = payloads.select(*keep, F.try_parse_json("payload").alias("p"))
    get = lambda path, kind: F.try_variant_get("p", path, kind)
    words = "array<string>"
    rows = rows.withColumns({
        "keys": F.array_sort(F.map_keys(get("$", "map<string,variant>"))), "probability": get("$.browsing_probability", "double"),
        "end": get("$.end_conversation", "boolean"), "action": get("$.category_action", "string"), "query": get("$.category_query", "string"),
        "group": get("$.catalog_group", "string"), "items": get("$.constraints_to_add", "array<variant>"),
        "remove": get("$.constraint_ids_to_remove", words), "declined": get("$.no_preference_facets", words),
        "summary": get("$.profile.summary", "string"), "tags": get("$.profile.preference_tags", words),
        "profile_keys": F.array_sort(F.map_keys(get("$.profile", "map<string,variant>"))),
    })
    item = lambda i: F.struct(
        _clean(F.coalesce(F.try_variant_get(i, "$.text", "string"), F.try_variant_get(i, "$.value", "string"))).alias("text"),
        F.when(F.schema_of_variant(F.try_variant_get(i, "$.hard", "variant")) == "BOOLEAN", F.try_variant_get(i, "$.hard", "boolean")).alias("hard"),
        F.array_sort(F.map_keys(F.try_variant_get(i, "$", "map<string,variant>"))).alias("keys"))
    rows = rows.withColumn("listed", F.transform("items", item)).withColumn("category", _clean(F.col("query")))
    text_ok = lambda c, n: F.coalesce((c != "") & (F.length(c) <= n), F.lit(False))
    shapes = (X._words(("hard", "text")), X._words(("hard", "type", "value")))
    strings = lambda c, path: F.col(c).isNotNull() & ~F.exists(F.col(c), lambda v: v.isNull()) & (_kind(path) == "ARRAY")
    repeated = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    texts = F.transform("listed", lambda i: X.normalized(i["text"]))
    no = lambda test, message: F.when(~F.coalesce(test, F.lit(False)), F.lit(message))
    replace, keep_it, clear = (F.col("action") == a for a in ("replace", "keep", "clear"))
    errors = F.array_compact(F.array(
        no(F.col("keys") == X._words(sorted(KEYS)), "update has an unexpected schema"),
        no(_kind("$.browsing_probability").isin("BIGINT", "DECIMAL", "DOUBLE") & F.col("probability").between(0.0, 1.0), "browsing_probability must be in [0, 1]"),
        no(_kind("$.end_conversation") == "BOOLEAN", "end_conversation must be a boolean"),
        no(F.col("action").isin("keep", "replace", "clear"), "category_action must be keep, replace, or clear"),
        F.when(replace, no(text_ok(F.col("category"), TEXT_CHARS), f"category_query must be non-empty and at most {TEXT_CHARS} characters")),
        F.when(clear & F.col("query").isNotNull(), "category_query is only allowed when replacing a category"),
        no(F.col("group").isin(*GROUPS), "catalog_group is invalid"),
        F.when(replace & (F.col("group") == "unknown"), "a replacement category cannot have an unknown group"),
        F.when(clear & (F.col("group") != "unknown"), "a cleared category must have an unknown group"),
        no(strings("remove", "$.constraint_ids_to_remove"), "constraint_ids_to_remove must be a list of strings"),
        no(strings("declined", "$.no_preference_facets"), "no_preference_facets must be a list of strings"),
        no(F.col("items").isNotNull(), "constraints_to_add must be a list"),
        no(F.forall("listed", lambda i: (i["keys"] == shapes[0]) | (i["keys"] == shapes[1])), "each constraint must contain text and hard"),
        no(F.forall("listed", lambda i: text_ok(i["text"], TEXT_CHARS)), f"constraint text must be non-empty and at most {TEXT_CHARS} characters"),
        no(F.forall("listed", lambda i: i["hard"].isNotNull()), "constraint hard must be a boolean"),
        F.when(repeated(texts), "constraints_to_add contains duplicate constraints"),
        no(F.col("profile_keys") == X._words(("preference_tags", "summary")), "profile must contain summary and preference_tags"),
        no(text_ok(_clean(F.col("summary")), MESSAGE_CHARS), f"profile summary must be non-empty and at most {MESSAGE_CHARS} characters"),
        no(strings("tags", "$.profile.preference_tags") & ~repeated("tags") & (F.size(F.array_except("tags", X._words(TAGS))) == 0),
           "profile contains an invalid preference tag"),
    ))
    additions = F.transform("listed", lambda i: F.struct(i["text"].alias("text"), i["hard"].alias("hard")))
    return rows.select(
        *keep, F.col("probability").alias("browsing_probability"), F.coalesce("end", F.lit(False)).alias("end_conversation"),
        F.col("action").alias("category_action"), F.when(F.col("query").isNotNull(), F.col("category")).alias("category_query"),
        F.col("group").alias("catalog_group"), additions.alias("additions"), F.col("remove").alias("remove_ids"),
        F.col("declined").alias("no_preference_facets"), F.col("tags").alias("profile_tags"), errors.alias("errors"))


def quarantine(updates: DataFrame) -> DataFrame:
    return updates.filter(F.size("errors") > 0)
