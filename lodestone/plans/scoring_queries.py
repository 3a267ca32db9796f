"""Scoring components, blends, question selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import messages as M
from lodestone.functions import vocab as V
from lodestone.operators import facets as FA
from lodestone.operators import scoring as SC
from lodestone.operators import vectors as D
from lodestone.plans import inputs as N
from lodestone.plans import sql as S
from lodestone.plans.registry import built_once, query
from lodestone.plans.search_queries import CANDIDATES, CENTROIDS, PART_SEARCH, centroid_queries, vectors
from lodestone.session import write_table
from lodestone.sources import adapters as A
from lodestone.sources import catalog as C

STATS = """
cstats AS (SELECT avg(average_rating) AS mean_rating, median(rating_number)::DOUBLE AS median_n, max(rating_number) AS max_n, count(*)::BIGINT AS products
           FROM products)"""


def components_sql(price_weight: str = "0.15", scale: str = "1.0", weights: str | None = None, extra: str = "") -> str:
    """Components and blended score of every candidate of every opening query."""
    w = weights or "CASE WHEN intent = 'buying' THEN {b} ELSE {r} END"
    weight = {c: "(" + w.format(b=V.INTENT_WEIGHTS["buying"][c], r=V.INTENT_WEIGHTS["browsing"][c], c=c) + ")::DOUBLE" for c in V.COMPONENTS}
    conf = f"(median_n * {scale})"
    return f"""{STATS},
qx AS (SELECT *, list_distinct({S.terms('category')}) AS qct,
              CASE WHEN constraint_text IS NOT NULL THEN list_distinct({S.terms('constraint_text')}) END AS cts FROM queries),
joined AS (
  SELECT c.query_id, c.parent_asin, c.lexical_rank, max(c.lexical_rank) OVER (PARTITION BY c.query_id) AS lexical_count,
         q.intent, q.category, q.constraint_text, q.hard, q.budget_max, q.qct, q.cts, p.* EXCLUDE (parent_asin), s.*
  FROM cand c JOIN qx q USING (query_id) JOIN products p USING (parent_asin), cstats s),
comp AS (
  SELECT *{extra},
    CASE WHEN lexical_rank IS NULL THEN 0.0::DOUBLE WHEN lexical_count <= 1 THEN 1.0::DOUBLE
         ELSE 1.0::DOUBLE - (lexical_rank - 1) / (lexical_count - 1)::DOUBLE END AS lexical,
    CASE WHEN category_key = lower(category) THEN 1.0::DOUBLE WHEN len(qct) = 0 THEN 0.0::DOUBLE
         ELSE len(list_intersect(qct, category_terms)) / len(qct)::DOUBLE END AS category_c,
    CASE WHEN cts IS NULL OR len(cts) = 0 THEN 0.0::DOUBLE
         ELSE len(list_intersect(cts, search_terms)) / len(cts)::DOUBLE END AS constraint_c,
    0.0::DOUBLE AS department_c,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((rating_number * average_rating + {conf} * mean_rating) / (rating_number + {conf}) - 1.0) / 4.0)) AS bayes,
    ln(1 + rating_number) / ln(1 + max_n) AS popularity,
    CASE WHEN budget_max IS NOT NULL THEN
      CASE WHEN price IS NULL THEN CASE WHEN hard THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END
           WHEN price <= budget_max THEN CASE WHEN price_is_lower_bound THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END
           ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - (price - budget_max) / greatest(budget_max, 1.0::DOUBLE)) END END AS price_fit
  FROM joined),
blend AS (
  SELECT *, ({weight['lexical']} * lexical + {weight['category']} * category_c
             + CASE WHEN constraint_text IS NOT NULL THEN {weight['constraint']} ELSE 0.0::DOUBLE END * constraint_c
             + {weight['bayesian_rating']} * bayes + {weight['popularity']} * popularity)
          / ({weight['lexical']} + {weight['category']} + CASE WHEN constraint_text IS NOT NULL THEN {weight['constraint']} ELSE 0.0::DOUBLE END
             + {weight['bayesian_rating']} + {weight['popularity']}) AS ordinary
  FROM comp),
scored AS (
  SELECT *, round(CASE WHEN budget_max IS NOT NULL THEN (1 - {price_weight}::DOUBLE) * ordinary + {price_weight}::DOUBLE * price_fit ELSE ordinary END, 9) AS score
  FROM blend)"""


SCORED = CANDIDATES + "," + components_sql()
RANK_ORDER = "score DESC, lexical_rank NULLS LAST, parent_asin"


def scored(spark, sf_dir):
    queries, products, stats = N.opening_queries(spark, sf_dir), N.part_products(spark, sf_dir), N.part_stats(spark, sf_dir)
    inside, outside = (SC.score_candidates(part, queries, products, stats) for part in N.opening_candidates(spark, sf_dir))
    return inside.unionByName(outside)


def best(spark, sf_dir, k, queries=None):
    """The best ``k`` candidates of every opening query, reading no more of a category than can matter."""
    return SC.blended_topk(
        N.opening_lexical(spark, sf_dir), queries or N.opening_queries(spark, sf_dir), N.part_products(spark, sf_dir), N.part_stats(spark, sf_dir), k)


@query("catalog_stats", f"""WITH {S.PRODUCTS}, {STATS}
SELECT round(mean_rating, 9) AS mean_rating, median_n AS median_rating_number, max_n AS max_rating_number, products AS product_count FROM cstats""")
def catalog_stats(spark, sf_dir):
    return C.catalog_stats(C.products(A.part_catalog(spark, sf_dir))).withColumn("mean_rating", F.round("mean_rating", 9))


@query("dominant_group_per_category", f"""WITH {S.PRODUCTS}
SELECT category_key, 'clothing' AS category_group, count(*)::BIGINT AS products FROM products GROUP BY 1""")
def dominant_group_per_category(spark, sf_dir):
    return C.group_per_category(N.part_products(spark, sf_dir))


@query("score_components", f"""WITH {SCORED}
SELECT query_id, parent_asin, round(lexical, 9) AS lexical, round(category_c, 9) AS category, round(constraint_c, 9) AS "constraint",
       department_c AS department_match, round(bayes, 9) AS bayesian_rating, round(popularity, 9) AS popularity,
       round(price_fit, 9) AS price_fit FROM scored""")
def score_components(spark, sf_dir):
    numbers = ["lexical", "category", "constraint", "bayesian_rating", "popularity", "price_fit"]
    return scored(spark, sf_dir).select(
        "query_id", "parent_asin", "department_match", *[F.round(c, 9).alias(c) for c in numbers])


@query("weighted_blend_top10", f"""WITH {SCORED}
SELECT * FROM (SELECT query_id, parent_asin, score, row_number() OVER (PARTITION BY query_id ORDER BY {RANK_ORDER}) AS rank FROM scored)
WHERE rank <= 10""")
def weighted_blend_top10(spark, sf_dir):
    return best(spark, sf_dir, 10).select("query_id", "parent_asin", "score", "rank")


DENSE_LIMIT = 50
# Every opening query takes the mean vector of one label, chosen by the length of its text.
DENSE = f"""{CENTROIDS},
chosen AS (SELECT query_id, CAST((length(query_text) % (SELECT count(DISTINCT label) FROM embeddings)) AS BIGINT) AS place FROM queries),
named AS (SELECT DISTINCT CAST(label AS VARCHAR) AS label, dense_rank() OVER (ORDER BY label) - 1 AS place FROM embeddings),
dense AS (
  SELECT c.query_id, d.parent_asin, d.similarity, row_number() OVER (PARTITION BY c.query_id ORDER BY d.similarity DESC, d.parent_asin) AS rank
  FROM chosen c JOIN named USING (place) JOIN sims d ON d.query_id = named.label WHERE d.parent_asin IN (SELECT parent_asin FROM products) QUALIFY rank <= {DENSE_LIMIT}),
calibrated AS (SELECT *, round(similarity - min(similarity) OVER (PARTITION BY query_id), 9) AS dense_score FROM dense)"""
_WEIGHT_SQL = f"CASE WHEN constraint_text IS NULL THEN 0.0::DOUBLE WHEN intent = 'buying' THEN {V.EMBEDDING_WEIGHTS['buying']}::DOUBLE ELSE {V.EMBEDDING_WEIGHTS['browsing']}::DOUBLE END"


@query("hybrid_top10", f"""WITH {PART_SEARCH}, {DENSE},
cand AS (
  SELECT query_id, parent_asin, max(r) AS lexical_rank FROM (
    SELECT query_id, parent_asin, rank AS r FROM lexical
    UNION ALL SELECT query_id, parent_asin, NULL FROM queries JOIN products ON lower(category) = category_key
    UNION ALL SELECT query_id, parent_asin, NULL FROM dense)
  GROUP BY ALL),
{components_sql()},
mixed AS (
  SELECT s.query_id, s.parent_asin, s.lexical_rank, coalesce(c.dense_score, 0.0::DOUBLE) AS dense_score,
         round((1 - {_WEIGHT_SQL}) * s.score + {_WEIGHT_SQL} * coalesce(c.dense_score, 0.0::DOUBLE), 9) AS score
  FROM scored s LEFT JOIN calibrated c USING (query_id, parent_asin))
SELECT query_id, parent_asin, dense_score, score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_score DESC, lexical_rank NULLS LAST, parent_asin) AS rank
FROM mixed QUALIFY rank <= 10""")
def hybrid_top10(spark, sf_dir):
    products, queries = N.part_products(spark, sf_dir), N.opening_queries(spark, sf_dir)
    labels = A.table(spark, sf_dir, "embeddings").select("label").distinct()
    named = labels.withColumn("place", F.dense_rank().over(Window.orderBy("label")) - 1)  # one row per label
    place = F.pmod(F.length("query_text"), F.lit(labels.count()))
    chosen = queries.select("query_id", place.alias("place")).join(named, "place")
    means = centroid_queries(spark, sf_dir).withColumnRenamed("query_id", "name")
    wanted = chosen.select("query_id", F.col("label").cast("string").alias("name")).join(means, "name").select("query_id", "embedding")
    rows = vectors(spark, sf_dir).join(products.select("parent_asin"), "parent_asin", "left_semi")
    matches = D.cell_topk(D.build_cells(rows), wanted, DENSE_LIMIT, 64)
    dense = write_table(D.dense_scores(matches, "margin"), "dense")
    best = D.hybrid_topk(N.opening_lexical(spark, sf_dir), dense, queries, products, N.part_stats(spark, sf_dir), V.TOP_K, DENSE_LIMIT)
    return best.select("query_id", "parent_asin", "dense_score", "score", "rank")


INTERPOLATED = CANDIDATES + "," + components_sql(weights="0.25 * {r} + 0.75 * {b}")


@query("intent_interpolation_top10", f"""WITH {INTERPOLATED}
SELECT * FROM (SELECT query_id, parent_asin, score, row_number() OVER (PARTITION BY query_id ORDER BY {RANK_ORDER}) AS rank FROM scored)
WHERE rank <= 10""")
def intent_interpolation_top10(spark, sf_dir):
    queries = N.opening_queries(spark, sf_dir).withColumn("browsing_probability", F.lit(0.25))
    return best(spark, sf_dir, 10, queries).select("query_id", "parent_asin", "score", "rank")


@query("recommendation_payload", f"""WITH {SCORED},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {RANK_ORDER}) AS rank FROM scored) WHERE rank <= 3)
SELECT query_id, parent_asin, rank, score, title, price, price_is_lower_bound, rating_number, average_rating, description FROM best""")
def recommendation_payload(spark, sf_dir):
    return SC.enrich(best(spark, sf_dir, 3), N.part_products(spark, sf_dir))


TOP100 = SCORED + f""",
top100 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {RANK_ORDER}) AS rank FROM scored) WHERE rank <= 100),
n100 AS (SELECT query_id, count(*)::BIGINT AS candidates FROM top100 GROUP BY 1),
vals AS (
  SELECT query_id, x.a AS attribute, lower(x.v) AS value FROM (
    SELECT query_id, unnest([
      {{'a': 'color', 'v': color}}, {{'a': 'style', 'v': department}}, {{'a': 'size', 'v': size}},
      {{'a': 'budget', 'v': CASE WHEN price < 15 THEN 'under $15' WHEN price < 25 THEN '$15-$25' WHEN price < 50 THEN '$25-$50'
                                 WHEN price < 100 THEN '$50-$100' WHEN price IS NOT NULL THEN 'over $100' END}},
      {{'a': 'feature', 'v': 'present'}}, {{'a': 'brand', 'v': brand}}]) AS x FROM top100) WHERE x.v IS NOT NULL),
vcounts AS (SELECT query_id, attribute, value, count(*)::BIGINT AS n FROM vals GROUP BY ALL),
gains AS (
  SELECT query_id, attribute, covered, distinct_values, entropy, covered / candidates::DOUBLE * entropy AS gain FROM (
    SELECT v.query_id, attribute, sum(n)::BIGINT AS covered, count(*)::BIGINT AS distinct_values, any_value(candidates) AS candidates,
           CASE WHEN count(*) > 1 THEN (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)) ELSE 0.0::DOUBLE END AS entropy
    FROM vcounts v JOIN n100 USING (query_id) GROUP BY v.query_id, attribute))"""


def top100(spark, sf_dir):
    return built_once(
        spark, sf_dir, "top100", build=lambda: write_table(best(spark, sf_dir, V.QUESTION_CANDIDATES), "top100"))


@query("information_gain", f"""WITH {TOP100}
SELECT query_id, attribute, covered, distinct_values, round(entropy, 9) AS entropy, round(gain, 9) AS information_gain FROM gains""")
def information_gain(spark, sf_dir):
    valued = FA.with_pool_size(top100(spark, sf_dir)).join(C.attribute_values(N.part_products(spark, sf_dir)), "parent_asin")
    return FA.information_gain(valued).withColumns({"entropy": F.round("entropy", 9), "information_gain": F.round("information_gain", 9)})


_PRIOR_SQL = "CASE attribute " + " ".join(
    f"WHEN '{a}' THEN {w}::DOUBLE" for a, w in V.ATTRIBUTE_PRIORS["clothing"].items()) + " END"
_POSITION_SQL = "CASE attribute " + " ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(V.QUESTION_ATTRIBUTES)) + " END"


@query("question_choice", f"""WITH {TOP100},
qs AS (SELECT query_id, attribute, round(0.65::DOUBLE * round(gain, 12) + 0.30::DOUBLE * {_PRIOR_SQL}, 9) AS score, {_POSITION_SQL} AS position
       FROM gains WHERE covered >= 5 AND attribute <> 'brand')
SELECT query_id, attribute AS ask_attribute, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS n FROM qs) WHERE n = 1""")
def question_choice(spark, sf_dir):
    pool = top100(spark, sf_dir).select("query_id", "parent_asin")
    products = N.part_products(spark, sf_dir)
    groups = C.question_category(N.opening_queries(spark, sf_dir), products)
    return FA.select_question(FA.question_scores(FA.question_gains(pool, C.attribute_values(products), groups)))


@query("facet_utility", f"""WITH {TOP100},
rec AS (SELECT query_id, attribute, sum(n)::BIGINT AS products, count(*)::BIGINT AS recurring, sum(n * ln(n)) AS s
        FROM vcounts WHERE n >= 2 GROUP BY ALL HAVING count(*) >= 2)
SELECT query_id, attribute, products, recurring, round(least(1.0::DOUBLE, sqrt(8.0::DOUBLE / recurring)), 9) AS penalty,
       round(products / candidates::DOUBLE, 9) AS answerability,
       round(products / candidates::DOUBLE * ((ln(products) - s / products) / ln(recurring)) * least(1.0::DOUBLE, sqrt(8.0::DOUBLE / recurring)), 9) AS discrimination
FROM rec JOIN n100 USING (query_id)""")
def facet_utility(spark, sf_dir):
    valued = FA.with_pool_size(top100(spark, sf_dir)).join(C.attribute_values(N.part_products(spark, sf_dir)), "parent_asin")
    return FA.recurring_utility(valued, ["query_id", "attribute"]).drop("candidates")


@query("category_novelty", f"""WITH {TOP100},
rec AS (SELECT v.query_id, attribute, value, n, list_distinct({S.terms('value')}) AS words, list_distinct({S.terms('category')}) AS known
        FROM vcounts v JOIN (SELECT DISTINCT query_id, category FROM queries) USING (query_id) WHERE n >= 2)
SELECT query_id, attribute, round(1 - sum(CASE WHEN len(words) > 0 AND len(list_filter(words, lambda w: NOT list_contains(known, w))) = 0
       THEN n ELSE 0 END) / sum(n)::DOUBLE, 9) AS novelty FROM rec GROUP BY ALL""")
def category_novelty(spark, sf_dir):
    pool = top100(spark, sf_dir).select("query_id", "parent_asin")
    valued = pool.join(C.attribute_values(N.part_products(spark, sf_dir)), "parent_asin")
    rows = FA.category_novelty(valued, N.opening_queries(spark, sf_dir), ["query_id", "attribute"])
    return rows.withColumn("novelty", F.round("novelty", 9))


@query("disclosed_facets", f"""WITH {TOP100},
v AS (SELECT DISTINCT query_id, attribute, list_distinct({S.terms('value')}) AS words FROM vals),
c AS (SELECT query_id, list_distinct({S.terms('constraint_text')}) AS words FROM queries WHERE constraint_text IS NOT NULL)
SELECT DISTINCT query_id, attribute FROM v JOIN c USING (query_id)
WHERE len(v.words) > 0 AND len(c.words) > 0
  AND (len(list_filter(v.words, lambda w: NOT list_contains(c.words, w))) = 0 OR len(list_filter(c.words, lambda w: NOT list_contains(v.words, w))) = 0)
UNION SELECT query_id, 'budget' FROM queries WHERE budget_max IS NOT NULL""")
def disclosed_facets(spark, sf_dir):
    pool = top100(spark, sf_dir).select("query_id", "parent_asin")
    valued = pool.join(C.attribute_values(N.part_products(spark, sf_dir)), "parent_asin")
    queries = N.opening_queries(spark, sf_dir)
    return FA.disclosed_facets(valued, queries.select("query_id", F.explode("constraints").alias("text")), queries)


# ---------------------------------------------------------------- message columns


@query("parse_opening_messages", f"""WITH {S.OPENINGS}
SELECT session_id, intent, category, constraint_text AS "constraint", hard, CASE WHEN constraint_text IS NULL THEN NULL
       WHEN hard THEN 'initial' ELSE 'initial_preference' END AS source FROM opened""")
def parse_opening_messages(spark, sf_dir):
    turns = A.shopping_turns(spark, sf_dir).filter("turn = 1")
    return turns.select("session_id", M.parse_opening("message").alias("p")).select("session_id", "p.*")


@query("parse_reply_messages", f"""WITH {S.TURNS}
SELECT session_id, turn, CASE WHEN u = '1' THEN 'override' WHEN u IN ('2', '3') THEN 'clarification' WHEN u = '4' THEN 'no_preference' ELSE 'other' END AS kind,
       CASE WHEN u = '1' THEN word WHEN u IN ('2', '3') THEN p_brand || ' | budget around $' || price ELSE '' END AS "values"
FROM turns WHERE turn > 1""")
def parse_reply_messages(spark, sf_dir):
    turns = A.shopping_turns(spark, sf_dir).filter("turn > 1")
    return turns.select("session_id", "turn", M.parse_reply("message").alias("p")).select(
        "session_id", "turn", "p.kind", F.array_join("p.values", " | ").alias("values"))


@query("budget_constraints", f"""WITH {S.TURNS}
SELECT session_id, turn, CASE WHEN (turn = 1 AND u = '4') OR (turn > 1 AND u IN ('2', '3')) THEN CAST(price AS DOUBLE) END AS maximum
FROM turns""")
def budget_constraints(spark, sf_dir):
    turns = A.shopping_turns(spark, sf_dir)
    texts = F.transform(F.split("message", ";"), lambda t: F.struct(t.alias("text"), F.lit(True).alias("hard")))
    return turns.select("session_id", "turn", M.last_budget(texts)["maximum"].alias("maximum"))


@query("budget_upper_bound", f"""WITH {S.TURNS}
SELECT session_id, turn, CASE WHEN price IS NOT NULL AND message LIKE '%$%' THEN CAST(price AS DOUBLE) END AS budget_upper FROM turns""")
def budget_upper_bound(spark, sf_dir):
    return A.shopping_turns(spark, sf_dir).select("session_id", "turn", M.budget_upper("message").alias("budget_upper"))


@query("negated_terms", """
WITH hits AS (
  SELECT doc_id, unnest(list_concat(
    regexp_extract_all(text, '(?i)(?:^|[^\\p{L}\\p{N}_])(?:not|no|without)\\s+(?:too\\s+)?([a-z0-9-]+)', 1),
    regexp_extract_all(text, '(?i)(?:^|[^\\p{L}\\p{N}_])(?:don''?t|do\\s+not)\\s+(?:want|need|prefer)\\s+([a-z0-9-]+)', 1))) AS term FROM documents)
SELECT doc_id, string_agg(DISTINCT lower(term), ' ' ORDER BY lower(term)) AS terms FROM hits
WHERE lower(term) NOT IN ('only', 'quite', 'sure', 'preference', 'additional', 'longer') GROUP BY doc_id""")
def negated_terms(spark, sf_dir):
    rows = A.table(spark, sf_dir, "documents").select("doc_id", M.negative_terms("text").alias("t"))
    return rows.filter(F.size("t") > 0).select("doc_id", F.array_join("t", " ").alias("terms"))


def _class_sql() -> str:
    cases = []
    for kind, words in M.CLASS_WORDS.items():
        test = f"list_has_any({S.terms('line', V.CONVERSATION_STOPWORDS)}, {S.word_list(words)})"
        if kind == "budget":
            test = f"({test} OR line LIKE '%$%')"
        cases.append(f"CASE WHEN {test} THEN '{kind}' END")
    return f"array_to_string(list_filter([{', '.join(cases)}], lambda k: k IS NOT NULL), ',')"


@query("message_classes", f"""
WITH l AS (SELECT text AS line FROM documents UNION ALL SELECT text FROM conversations UNION ALL SELECT p_name || ' $' || p_retailprice FROM part)
SELECT {_class_sql()} AS classes, count(*)::BIGINT AS messages FROM l GROUP BY 1""")
def message_classes(spark, sf_dir):
    lines = A.table(spark, sf_dir, "documents").select(F.col("text").alias("line")).unionByName(
        A.table(spark, sf_dir, "conversations").select(F.col("text").alias("line"))).unionByName(
        A.table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" $"), F.col("p_retailprice").cast("string")).alias("line")))
    return lines.groupBy(F.array_join(M.classify_message("line", V.CONVERSATION_STOPWORDS), ",").alias("classes")).agg(F.count("*").alias("messages"))
