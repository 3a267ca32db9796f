"""Scalar text and attribute functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import vocab as V
from lodestone.plans import sql as S
from lodestone.plans.registry import query
from lodestone.sources import adapters as A
from lodestone.sources import catalog as C


@query("text_flatten", f"""
WITH {S.PART_CATALOG}
SELECT parent_asin, array_to_string(features, ' ') AS features_text, {S.DETAILS_TEXT} AS details_text,
       array_to_string(list_transform(details, lambda d: d.k || ': ' || d.v), ' | ') AS detail_entries,
       array_to_string(list_sort(list_transform(details, lambda d: d.k || ': ' || d.v)), ' | ') AS sorted_entries
FROM catalog""")
def text_flatten(spark, sf_dir):
    return A.part_catalog(spark, sf_dir).select(
        "parent_asin", X.join_list("features").alias("features_text"), X.join_map("details").alias("details_text"),
        F.array_join(X.flatten_map("details"), " | ").alias("detail_entries"),
        F.array_join(X.flatten_map("details", sort=True), " | ").alias("sorted_entries"))


@query("text_terms", f"SELECT doc_id, array_to_string({S.terms('text')}, ' ') AS terms FROM documents")
def text_terms(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.terms("text"), " ").alias("terms"))


@query("text_index_tokens", f"SELECT doc_id, array_to_string({S.index_tokens('text')}, ' ') AS tokens FROM documents")
def text_index_tokens(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.index_tokens("text"), " ").alias("tokens"))


@query("text_terms_conversational", f"""
SELECT conv_id, turn, array_to_string({S.terms('text', V.CONVERSATION_STOPWORDS)}, ' ') AS terms FROM conversations""")
def text_terms_conversational(spark, sf_dir):
    return A.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(X.terms("text", V.CONVERSATION_STOPWORDS), " ").alias("terms"))


@query("text_normalized", f"SELECT doc_id, {S.normalized('text')} AS normalized FROM documents")
def text_normalized(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", X.normalized("text").alias("normalized"))


@query("text_query_terms", f"""
WITH raw AS (SELECT item_id, {S.terms('text')} AS ts FROM benchmark),
seq AS (SELECT item_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM raw),
firsts AS (SELECT item_id, term, min(pos) AS pos FROM seq GROUP BY ALL),
kept AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS n FROM firsts)
SELECT item_id, string_agg(term, ' ' ORDER BY n) AS query_terms, count(*)::BIGINT AS n_terms
FROM kept WHERE n <= {V.QUERY_TERM_LIMIT} GROUP BY item_id""")
def text_query_terms(spark, sf_dir):
    listed = A.table(spark, sf_dir, "benchmark").select("item_id", X.query_terms("text").alias("ts"))
    return listed.filter(F.size("ts") > 0).select(
        "item_id", F.array_join("ts", " ").alias("query_terms"), F.size("ts").cast("bigint").alias("n_terms"))


@query("category_labels", f"""
WITH {S.PART_CATALOG}
SELECT parent_asin, categories[2] || ' ' || categories[3] AS coarse_category,
       array_to_string(categories, '/') AS specific, 'clothing' AS category_group,
       CASE WHEN categories[3] = 'Ring' THEN 'jewelry' ELSE 'other' END AS fine_group,
       CASE WHEN categories[3] = 'Ring' THEN 'jewelry' ELSE 'clothing' END AS head_group
FROM catalog""")
def category_labels(spark, sf_dir):
    return A.part_catalog(spark, sf_dir).select(
        "parent_asin", X.coarse_category("categories").alias("coarse_category"),
        F.array_join(X.specific_categories("categories"), "/").alias("specific"),
        X.category_group("categories").alias("category_group"), X.fine_category_group("categories").alias("fine_group"),
        X.head_noun_group(X.coarse_category("categories")).alias("head_group"))


@query("price_parse", f"""
WITH {S.PART_CATALOG},
parsed AS (
  SELECT parent_asin, price,
         CASE WHEN price LIKE 'from %' THEN CAST(substr(price, 6) AS DOUBLE) ELSE try_cast(price AS DOUBLE) END AS number,
         price LIKE 'from %' AS is_lower_bound,
         round(CAST(nullif(regexp_extract(price, '[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE), 2) AS first_number
  FROM catalog)
SELECT parent_asin, number, is_lower_bound, first_number,
       CASE WHEN is_lower_bound THEN 'lower_bound' WHEN number IS NULL THEN 'missing' ELSE 'exact' END AS kind,
       CASE WHEN number < 15 THEN 'under $15' WHEN number < 25 THEN '$15-$25' WHEN number < 50 THEN '$25-$50'
            WHEN number < 100 THEN '$50-$100' WHEN number IS NOT NULL THEN 'over $100' END AS band,
       CASE WHEN first_number < 25 THEN 'under 25' WHEN first_number < 50 THEN '25 to 49' WHEN first_number < 100 THEN '50 to 99'
            WHEN first_number IS NOT NULL THEN '100 or more' END AS bucket
FROM parsed""")
def price_parse(spark, sf_dir):
    return A.part_catalog(spark, sf_dir).select(
        "parent_asin", X.price_number("price").alias("number"), X.price_is_lower_bound("price").alias("is_lower_bound"),
        X.first_number("price").alias("first_number"), X.price_kind("price").alias("kind"),
        X.price_band(X.price_number("price")).alias("band"), X.budget_bucket(X.first_number("price")).alias("bucket"))


def _audience_sql(expr: str, text: str) -> str:
    has = lambda words: f"list_has_any({expr}, {S.word_list(words)})"
    cases = [f"WHEN {has(['unisex'])} AND {has(V.AUDIENCE_BABY)} THEN 'unisex baby'",
             f"WHEN {has(['unisex'])} AND {has(V.AUDIENCE_CHILD)} THEN 'unisex child'",
             f"WHEN {has(['unisex'])} THEN 'unisex adult'"]
    cases += [f"WHEN {has(words)} THEN '{label}'" for label, words in V.AUDIENCE_RULES]
    return f"CASE {' '.join(cases)} ELSE nullif({S.normalized(text)}, '') END"


@query("department_normalize", f"""
WITH d AS (SELECT doc_id, source || ' ' || {S.FIRST_LINE} AS label FROM documents)
SELECT doc_id, {_audience_sql(S.terms("replace(label, '-', ' ')"), 'label')} AS department,
       CASE WHEN list_has_any({S.terms('label')}, {S.word_list(V.AUDIENCE_WORDS)})
            THEN {_audience_sql(S.terms("replace(label, '-', ' ')"), 'label')} END AS explicit_department
FROM d""")
def department_normalize(spark, sf_dir):
    label = F.concat("source", F.lit(" "), F.element_at(F.split("text", "\n"), 1))
    return A.table(spark, sf_dir, "documents").select(
        "doc_id", X.normalize_department(label).alias("department"), X.extract_department(label).alias("explicit_department"))


@query("first_detail", f"""
WITH {S.PART_CATALOG}
SELECT parent_asin, split_part(title, ' ', 1) AS style, lower(p_brand) AS brand, CAST(p_size AS VARCHAR) AS size,
       NULL::VARCHAR AS use_case FROM catalog""")
def first_detail(spark, sf_dir):
    return A.part_catalog(spark, sf_dir).select(
        "parent_asin", X.first_detail("details", V.STYLE_KEYS).alias("style"), X.first_detail("details", V.BRAND_KEYS).alias("brand"),
        X.first_detail("details", V.SIZE_KEYS).alias("size"), X.first_detail("details", V.USE_CASE_KEYS).alias("use_case"))


@query("first_material_color", f"""
SELECT p_partkey, {S.first_word('p_name', V.COLORS)} AS color, {S.first_word('p_name', V.MATERIALS)} AS material FROM part""")
def first_material_color(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select(
        "p_partkey", X.first_color("p_name").alias("color"), X.first_material("p_name").alias("material"))


@query("searchable_text", f"""
WITH {S.PART_CATALOG}
SELECT parent_asin, title || ' ' || array_to_string(features, ' ') || ' ' || {S.DETAILS_TEXT} || ' ' ||
       array_to_string(description, ' ') || ' ' || array_to_string(categories, ' ') || ' ' || store AS searchable FROM catalog""")
def searchable_text(spark, sf_dir):
    return A.part_catalog(spark, sf_dir).select("parent_asin", X.searchable_text().alias("searchable"))


@query("attribute_values", f"""
WITH {S.PRODUCTS},
long AS (
  SELECT parent_asin, unnest([
    {{'a': 'material', 'v': material}}, {{'a': 'color', 'v': color}}, {{'a': 'style', 'v': coalesce(department, style)}},
    {{'a': 'size', 'v': size}}, {{'a': 'brand', 'v': brand}}, {{'a': 'use_case', 'v': use_case}},
    {{'a': 'budget', 'v': CASE WHEN price < 15 THEN 'under $15' WHEN price < 25 THEN '$15-$25' WHEN price < 50 THEN '$25-$50'
                             WHEN price < 100 THEN '$50-$100' WHEN price IS NOT NULL THEN 'over $100' END}},
    {{'a': 'feature', 'v': CASE WHEN has_features THEN 'present' END}}]) AS x FROM products)
SELECT parent_asin, x.a AS attribute, x.v AS value FROM long WHERE x.v IS NOT NULL""")
def attribute_values(spark, sf_dir):
    return C.attribute_values(C.products(A.part_catalog(spark, sf_dir)))


@query("clean_constraint", """
WITH s AS (SELECT conv_id, turn, trim(regexp_replace(text, '[\\s\\x{00a0}]+', ' ', 'g'), ' -;,.') AS t FROM conversations)
SELECT conv_id, turn, rtrim(substr(t, 1, 180)) AS cleaned FROM s""")
def clean_constraint(spark, sf_dir):
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.clean_constraint("text").alias("cleaned"))


def _classify_sql(expr: str) -> str:
    cases = [f"WHEN {expr} LIKE '%budget%' OR regexp_matches({expr}, '(\\$|<=|under)\\s*[0-9]') THEN 'budget'"]
    for kind, words in V.CONSTRAINT_TYPES:
        cases.append(f"WHEN regexp_matches({expr}, '{'|'.join(words)}') THEN '{kind}'")
    return f"CASE {' '.join(cases)} ELSE 'feature' END"


@query("classify_constraint", f"""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, {_classify_sql('lower(line)')} AS kind, count(*)::BIGINT AS lines FROM s GROUP BY ALL""")
def classify_constraint(spark, sf_dir):
    lines = A.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id", X.classify_constraint("line").alias("kind")).agg(F.count("*").alias("lines"))


PURCHASES = """
bought AS (
  SELECT o_custkey, l_partkey, l_quantity, o_orderdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
purchases AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS parent_asin,
         least(5.0::DOUBLE, floor(l_quantity / 10.0) + 1.0)::DOUBLE AS rating,
         coalesce(array_to_string(list(CAST(l_partkey AS VARCHAR)) OVER w4, ' '), '') AS history,
         row_number() OVER w AS purchase_no
  FROM bought
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice),
         w4 AS (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
                ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))"""

STYLE_SQL = "CASE WHEN rating >= 5 THEN 'usually positive' WHEN rating >= 4 THEN 'mixed' ELSE 'critical' END"
FREQUENCY_SQL = (
    "CASE len(list_filter(string_split(history, ' '), lambda h: h <> '')) WHEN 0 THEN 'no prior purchases' "
    "WHEN 1 THEN '1 prior purchase' WHEN 2 THEN '2 prior purchases' ELSE '3-4 prior purchases' END")


@query("purchase_profile", f"""
WITH {PURCHASES}
SELECT user_id, purchase_no, parent_asin, {FREQUENCY_SQL} AS frequency, {STYLE_SQL} AS rating_style FROM purchases""")
def purchase_profile(spark, sf_dir):
    return A.purchases(spark, sf_dir).select(
        "user_id", F.col("purchase_no").cast("bigint").alias("purchase_no"), "parent_asin",
        X.purchase_frequency("history").alias("frequency"), X.rating_style("rating").alias("rating_style"))


@query("product_rows", f"""
WITH {S.PRODUCTS}
SELECT parent_asin, title, description, coarse_category, category_key, array_to_string(list_sort(category_terms), ' ') AS category_terms,
       array_to_string(list_sort(search_terms), ' ') AS search_terms, round(average_rating, 6) AS average_rating, rating_number, price,
       price_is_lower_bound, department, material, color, style, size, brand, use_case, has_features FROM products""")
def product_rows(spark, sf_dir):
    rows = C.products(A.part_catalog(spark, sf_dir))
    return rows.select(
        "parent_asin", "title", "description", "coarse_category", "category_key",
        F.array_join(F.array_sort("category_terms"), " ").alias("category_terms"),
        F.array_join(F.array_sort("search_terms"), " ").alias("search_terms"), F.round("average_rating", 6).alias("average_rating"),
        "rating_number", "price", "price_is_lower_bound", "department", "material", "color", "style", "size", "brand", "use_case",
        "has_features")
