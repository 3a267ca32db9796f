"""The scalar text functions as functions of SQL text.

Each is a temporary function with a SQL body: a statement that calls it is planned with the body in its place, so it stays inside
generated code and no Python runs.  Spark takes no such function inside a lambda; the bodies there spell their parts out.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from lodestone.functions import vocab as V


def _listed(words) -> str:
    return ", ".join("'" + w.replace("'", r"\'") + "'" for w in words)


def _words(words) -> str:
    return f"array({_listed(words)})"


def _tokens(stopwords, of: str = "value") -> str:
    return (
        f"filter(transform(regexp_extract_all({of}, r'(?iU)[a-z0-9]+', 0), t -> lower(t)), t -> length(t) > 1 AND t NOT IN ({_listed(stopwords)}))")


def _any_word(words) -> str:
    return f"nullif(lower(regexp_extract(value, r'(?iU)\\b({'|'.join(words)})\\b', 1)), '')"


def _normal(of: str) -> str:
    return rf"lower(trim(regexp_replace({of}, r'(?U)\s+', ' ')))"


_NODES = "transform(CASE WHEN size(value) > 1 THEN slice(value, 2, size(value) - 1) ELSE CAST(array() AS ARRAY<STRING>) END, n -> " + _normal("n") + ")"
_BARE = "product_terms(replace(value, '-', ' '))"
_DEPARTMENT = " ".join([
    "CASE WHEN value IS NULL OR value = '' THEN NULL",
    f"WHEN array_contains({_BARE}, '{V.AUDIENCE_UNISEX}') AND arrays_overlap({_BARE}, {_words(V.AUDIENCE_BABY)}) THEN 'unisex baby'",
    f"WHEN array_contains({_BARE}, '{V.AUDIENCE_UNISEX}') AND arrays_overlap({_BARE}, {_words(V.AUDIENCE_CHILD)}) THEN 'unisex child'",
    f"WHEN array_contains({_BARE}, '{V.AUDIENCE_UNISEX}') THEN 'unisex adult'",
    *[f"WHEN arrays_overlap({_BARE}, {_words(words)}) THEN '{label}'" for label, words in V.AUDIENCE_RULES],
    "ELSE nullif(product_normalized(value), '') END"])
_KINDS = " ".join([
    r"CASE WHEN value IS NULL THEN 'feature' WHEN contains(lower(value), 'budget') OR lower(value) RLIKE r'(\$|<=|under)\s*[0-9]' THEN 'budget'",
    *[f"WHEN lower(value) RLIKE r'{'|'.join(re.escape(w) for w in words)}' THEN '{kind}'" for kind, words in V.CONSTRAINT_TYPES],
    "ELSE 'feature' END"])
_HISTORY = r"size(filter(split(coalesce(value, ''), r'(?U)\s+'), w -> w <> ''))"
_EMPTY = "CAST(array() AS ARRAY<STRING>)"
_LABELS = (
    f"filter(transform(flatten(transform(coalesce(value, {_EMPTY}), v -> split(v, ','))), p -> regexp_replace(p, r'(?U)^\\s+|\\s+$', '')), "
    f"p -> p <> '' AND lower(p) NOT IN ({_listed(V.UMBRELLA_LABELS)}))")

# Name, type of the one parameter ``value``, type of the result, body.  A body may call those before it.
FUNCTIONS = (
    ("product_terms", "STRING", "ARRAY<STRING>", _tokens(V.STOPWORDS)),
    ("conversation_terms", "STRING", "ARRAY<STRING>", _tokens(V.CONVERSATION_STOPWORDS)),
    ("query_terms", "STRING", "ARRAY<STRING>", f"slice(array_distinct(product_terms(value)), 1, {V.QUERY_TERM_LIMIT})"),
    ("product_normalized", "STRING", "STRING", _normal("value")),
    ("coarse_category", "ARRAY<STRING>", "STRING",
     f"coalesce(nullif(array_join(reverse(slice(reverse({_LABELS}), 1, 2)), ' '), ''), '{V.DEFAULT_CATEGORY}')"),
    ("specific_categories", "ARRAY<STRING>", "ARRAY<STRING>",
     f"filter(coalesce(value, {_EMPTY}), v -> array_join({_tokens(V.STOPWORDS, 'v')}, ' ') NOT IN ({_listed(V.GENERIC_CATEGORIES)}))"),
    ("category_group", "ARRAY<STRING>", "STRING",
     f"CASE WHEN exists({_NODES}, n -> n IN ('shoes', 'boot shop')) THEN 'shoes' WHEN exists({_NODES}, n -> contains(n, 'jewelry')) THEN 'jewelry' ELSE 'clothing' END"),
    ("fine_category_group", "ARRAY<STRING>", "STRING",
     f"CASE WHEN exists({_NODES}, n -> n IN ('shoes', 'boot shop') OR arrays_overlap({_tokens(V.STOPWORDS, 'n')}, {_words(V.SHOE_TERMS)})) THEN 'shoes' "
     f"WHEN exists({_NODES}, n -> n = 'jewelry' OR (n <> 'jewelry watch accessories' AND arrays_overlap({_tokens(V.STOPWORDS, 'n')}, {_words(V.JEWELRY_TERMS)}))) THEN 'jewelry' "
     f"WHEN array_contains({_NODES}, 'clothing') THEN 'clothing' ELSE 'other' END"),
    ("head_noun_group", "STRING", "STRING",
     f"CASE WHEN arrays_overlap(product_terms(value), {_words(V.SHOE_TERMS)}) THEN 'shoes' "
     f"WHEN arrays_overlap(product_terms(value), {_words(V.JEWELRY_TERMS)}) THEN 'jewelry' ELSE 'clothing' END"),
    ("price_is_lower_bound", "STRING", "BOOLEAN", r"coalesce(trim(value) RLIKE r'(?i)^from\s+[0-9]+(\.[0-9]+)?$', false)"),
    ("price_number", "STRING", "DOUBLE",
     r"nullif(coalesce(CASE WHEN trim(value) RLIKE r'^[+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?$' THEN try_cast(trim(value) AS DOUBLE) END, "
     r"try_cast(nullif(regexp_extract(trim(value), r'(?i)^from\s+([0-9]+(?:\.[0-9]+)?)$', 1), '') AS DOUBLE)), double('Infinity'))"),
    ("price_kind", "STRING", "STRING",
     "CASE WHEN price_is_lower_bound(value) THEN 'lower_bound' WHEN price_number(value) IS NOT NULL THEN 'exact' ELSE 'missing' END"),
    ("first_number", "STRING", "DOUBLE", r"bround(try_cast(nullif(regexp_extract(coalesce(value, ''), r'[0-9]+(?:\.[0-9]+)?', 0), '') AS DOUBLE), 2)"),
    ("price_band", "DOUBLE", "STRING",
     "CASE WHEN value IS NULL THEN NULL WHEN value < 15 THEN 'under $15' WHEN value < 25 THEN '$15-$25' WHEN value < 50 THEN '$25-$50' "
     "WHEN value < 100 THEN '$50-$100' ELSE 'over $100' END"),
    ("budget_bucket", "DOUBLE", "STRING",
     "CASE WHEN value IS NULL THEN NULL WHEN value < 25 THEN 'under 25' WHEN value < 50 THEN '25 to 49' WHEN value < 100 THEN '50 to 99' ELSE '100 or more' END"),
    ("normalized_department", "STRING", "STRING", _DEPARTMENT),
    ("explicit_department", "STRING", "STRING",
     f"CASE WHEN arrays_overlap(product_terms(value), {_words(V.AUDIENCE_WORDS)}) THEN normalized_department(value) END"),
    ("first_material", "STRING", "STRING", _any_word(V.MATERIALS)),
    ("first_color", "STRING", "STRING", _any_word(V.COLORS)),
    ("clean_constraint", "STRING", "STRING",
     r"regexp_replace(substring(regexp_replace(regexp_replace(value, r'(?U)\s+', ' '), r'^[ \-;,.\t\n]+|[ \-;,.\t\n]+$', ''), 1, 180), r'(?U)\s+$', '')"),
    ("constraint_kind", "STRING", "STRING", _KINDS),
    ("purchase_frequency", "STRING", "STRING",
     f"CASE WHEN {_HISTORY} = 0 THEN 'no prior purchases' WHEN {_HISTORY} = 1 THEN '1 prior purchase' "
     f"WHEN {_HISTORY} = 2 THEN '2 prior purchases' ELSE '3-4 prior purchases' END"),
    ("rating_style", "DOUBLE", "STRING", "CASE WHEN value >= 5 THEN 'usually positive' WHEN value >= 4 THEN 'mixed' ELSE 'critical' END"),
)


def register(spark: SparkSession) -> list[str]:
    """Define all functions for the session, replacing earlier ones of their names; returns the names."""
    for name, takes, gives, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(value {takes}) RETURNS {gives} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
