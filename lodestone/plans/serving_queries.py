"""Served pages and questions that depend on what a session has seen and answered so far."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import facets as FA
from lodestone.plans import extraction_queries as EX
from lodestone.plans import inputs as N
from lodestone.plans import scoring_queries as SQ
from lodestone.plans import sql as S
from lodestone.plans.registry import query
from lodestone.sources import adapters as A
from lodestone.sources import catalog as C
from lodestone.streaming import sessions as ST

# A supplier's sales by half-years: fourteen turns of a session, with a new version after every fifth.
SALES = """
sales AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS session_id, (year(l_shipdate) - 1992) * 2 + CASE WHEN month(l_shipdate) > 6 THEN 2 ELSE 1 END AS turn,
         CAST(l_partkey AS VARCHAR) AS parent_asin, sum(l_quantity) AS sold FROM lineitem GROUP BY ALL),
lists AS (
  SELECT session_id, turn, (turn - 1) // 5 + 1 AS version, list(parent_asin ORDER BY sold DESC, parent_asin) AS ranked,
         row_number() OVER (PARTITION BY session_id ORDER BY turn) AS n FROM sales GROUP BY session_id, turn)"""


def sold_ranks(spark, sf_dir):
    """Parts of every supplier by quantity sold, for each half-year."""
    sold = A.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").cast("string").alias("session_id"),
        ((F.year("l_shipdate") - 1992) * 2 + F.when(F.month("l_shipdate") > 6, 2).otherwise(1)).cast("int").alias("turn"),
        F.col("l_partkey").cast("string").alias("parent_asin")).agg(F.sum("l_quantity").alias("sold"))
    order = Window.partitionBy("session_id", "turn").orderBy(F.desc("sold"), F.asc("parent_asin"))
    return sold.select(
        "session_id", "turn", (F.floor((F.col("turn") - 1) / 5) + 1).cast("int").alias("version"), "parent_asin", F.row_number().over(order).alias("rank"))


def _pages_sql(order: str) -> str:
    """Pages told turn by turn; ``order`` picks from ``ranked``, with ``seen`` shown under the version and ``age`` its page."""
    return f"""WITH RECURSIVE {SALES},
walk AS (
  SELECT session_id, turn, version, n, 1 AS age, ranked[1:10] AS page, ranked[1:10] AS shown FROM lists WHERE n = 1
  UNION ALL
  SELECT session_id, turn, version, n, age, page, list_concat(seen, page) FROM (
    SELECT *, ({order})[1:10] AS page FROM (
      SELECT l.*, CASE WHEN w.version = l.version THEN w.age + 1 ELSE 1 END AS age, CASE WHEN w.version = l.version THEN w.shown ELSE [] END AS seen
      FROM walk w JOIN lists l ON l.session_id = w.session_id AND l.n = w.n + 1)))
SELECT session_id, turn, array_to_string(page, ',') AS recommendations FROM walk"""


@query("served_pages", _pages_sql("list_filter(ranked, lambda p: NOT list_contains(seen, p))"))
def served_pages(spark, sf_dir):
    return ST.served_pages(sold_ranks(spark, sf_dir)).withColumn("recommendations", F.array_join("recommendations", ","))


@query("grace_pages", _pages_sql(
    "CASE WHEN age <= 2 THEN ranked ELSE list_concat(list_filter(ranked, lambda p: NOT list_contains(seen, p)), list_filter(ranked, lambda p: list_contains(seen, p))) END"))
def grace_pages(spark, sf_dir):
    return ST.served_pages(sold_ranks(spark, sf_dir), paginate=True).withColumn("recommendations", F.array_join("recommendations", ","))


# ---------------------------------------------------------------- questions by state


def asked_so_far(spark, sf_dir):
    """What every turn's session has been asked, has answered and has declined; the form of its opening stands for a profile."""
    upto = Window.partitionBy("session_id").orderBy("turn")
    attribute = F.col("last_asked_attribute")
    declined, answered = F.col("message").startswith("I don't have a preference"), F.col("message").startswith("For that")
    opening = F.first("message").over(upto)
    tags = F.when(opening.contains("A key requirement"), F.array(F.lit("fit"))).when(opening.contains("exploring"), F.array(F.lit("weather"))).otherwise(
        F.array().cast("array<string>"))
    return A.shopping_turns(spark, sf_dir).select(
        "session_id", "turn", "message", F.collect_set(attribute).over(upto).alias("asked"),
        F.collect_set(F.when(declined, attribute)).over(upto).alias("no_preference"),
        F.collect_set(F.when(answered, attribute)).over(upto).alias("follow_up"), tags.alias("profile_tags"))


HISTORY = """
told AS (
  SELECT a.session_id, a.turn, b.last_asked_attribute AS attribute, bool_or(b.u = '4') AS declined, bool_or(b.u IN ('2', '3')) AS answered
  FROM turns a JOIN turns b ON b.session_id = a.session_id AND b.turn <= a.turn AND b.turn > 1 GROUP BY ALL)"""


@query("question_choice_by_turn", f"""WITH {SQ.TOP100}, {HISTORY},
opens AS (
  SELECT session_id, intent || '|' || category || '|' || coalesce(constraint_text, '') AS query_id,
         CASE WHEN hard THEN ['style'] WHEN intent = 'browsing' THEN ['use_case', 'feature'] ELSE [] END AS hints FROM opened),
asked_scores AS (
  SELECT t.session_id, t.turn, g.attribute, CASE WHEN h.attribute IS NULL THEN 0 ELSE 1 END AS stage, {SQ._POSITION_SQL} AS position,
         round(0.65::DOUBLE * round(gain, 12) + 0.30::DOUBLE * {SQ._PRIOR_SQL} + CASE WHEN list_contains(hints, g.attribute) THEN 0.05::DOUBLE ELSE 0 END, 9) AS score
  FROM turns t JOIN opens USING (session_id) JOIN gains g USING (query_id)
  LEFT JOIN told h ON h.session_id = t.session_id AND h.turn = t.turn AND h.attribute = g.attribute
  WHERE covered >= 5 AND g.attribute <> 'brand' AND (h.attribute IS NULL OR (h.answered AND NOT h.declined)))
SELECT session_id, turn, attribute AS ask_attribute, score FROM asked_scores
QUALIFY row_number() OVER (PARTITION BY session_id, turn ORDER BY stage, score DESC, position) = 1""".replace("CASE attribute", "CASE g.attribute"))
def question_choice_by_turn(spark, sf_dir):
    """The next question of every turn: fresh attributes first, then follow-ups of answered ones, never declined ones."""
    products = N.part_products(spark, sf_dir)
    groups = C.question_category(N.opening_queries(spark, sf_dir), products)
    gains = FA.question_gains(SQ.top100(spark, sf_dir).select("query_id", "parent_asin"), C.attribute_values(products), groups)
    state = asked_so_far(spark, sf_dir).join(N.session_openings(spark, sf_dir).select("session_id", "query_id"), "session_id")
    scores = FA.question_scores(gains, state, keep=["session_id", "turn"])
    return FA.select_question(scores, ["session_id", "turn"])


_LEFT = "list_filter(" + S.word_list(FA.QUESTION_ORDER) + ", lambda a: NOT list_contains(asked, a))"


@query("fixed_order_questions", f"""WITH {S.TURNS}, {HISTORY},
blocked AS (SELECT t.session_id, t.turn, t.u, coalesce((SELECT list(attribute) FROM told h WHERE h.session_id = t.session_id AND h.turn = t.turn), []) AS asked FROM turns t)
SELECT session_id, turn, CASE WHEN turn >= 10 THEN NULL WHEN turn > 1 AND u = '5' THEN 'other' ELSE ({_LEFT})[1] END AS ask_attribute FROM blocked""")
def fixed_order_questions(spark, sf_dir):
    """Every turn's question by the fixed order; one that asks for any specific attribute is asked openly."""
    state = asked_so_far(spark, sf_dir).select(
        "session_id", "turn", F.col("asked").alias("blocked"), F.col("message").startswith("Those options are not quite right").alias("prefer_other"))
    return FA.fixed_order_question(state)


# ---------------------------------------------------------------- fine facets


def _registry_sql() -> str:
    rows = []
    for group, priors in FA.FAMILY_PRIORS.items():
        facets = [(f, family, source, public) for g, _, f, family, source, public in FA.COMMON_FACETS if g == group]
        facets += [(f, family, "specific", "feature") for family, names in FA.SPECIFIC_FACETS[group].items() for f in names]
        rows += [f"('{group}', '{f}', '{family}', '{source}', '{public}', {i}, {priors[family]}::DOUBLE)" for i, (f, family, source, public) in enumerate(facets)]
    return ", ".join(rows)


def _choice_sql(place: int, exclude: str = "true") -> str:
    """CTEs of one choice over ``facts``."""
    return f"""
open{place} AS (SELECT * FROM facts f WHERE {exclude} QUALIFY stage = min(stage) OVER (PARTITION BY query_id)),
known{place} AS (SELECT o.query_id, o.family, count(DISTINCT k.parent_asin)::BIGINT AS answerable
  FROM open{place} o JOIN kv k USING (query_id, facet) JOIN rec r USING (query_id, facet, value) GROUP BY ALL),
leaf{place} AS (SELECT * FROM open{place} QUALIFY row_number() OVER (PARTITION BY query_id, family
  ORDER BY round(novelty * (0.50 * discrimination + 0.15 * answerability), 9) DESC, position) = 1),
chosen{place} AS (
  SELECT query_id, {place} AS place, facet, family, public_attribute,
         round(novelty * (0.50 * discrimination + 0.15 * answerable / candidates::DOUBLE + 0.30 * prior + 0.05 * hinted), 9) AS score
  FROM leaf{place} JOIN known{place} USING (query_id, family) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) = 1)"""


FACETS = f"""{SQ.TOP100},
prim AS (WITH {EX.REPAIRED} SELECT parent_asin, field, CASE WHEN field = 'specific_attributes' THEN name END AS name, value FROM fixed WHERE coalesce(name, '') <> 'closure_type'),
reg(question_group, facet, family, source, public_attribute, position, prior) AS (VALUES {_registry_sql()}),
grp AS (SELECT query_id, question_group FROM (
  SELECT query_id, CASE WHEN category_path[3] = 'Ring' THEN 'jewelry' ELSE 'other' END AS question_group, count(*) AS n
  FROM (SELECT query_id, parent_asin FROM top100) JOIN products USING (parent_asin) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, question_group) = 1),
allv AS (
  SELECT parent_asin, coalesce(name, field) AS facet, CASE WHEN name IS NULL THEN 'core' ELSE 'specific' END AS source, value FROM prim
  UNION ALL SELECT parent_asin, 'brand', 'catalog', brand FROM products
  UNION ALL SELECT parent_asin, 'budget', 'catalog', CASE WHEN price < 15 THEN 'under $15' WHEN price < 25 THEN '$15-$25' WHEN price < 50 THEN '$25-$50'
    WHEN price < 100 THEN '$50-$100' ELSE 'over $100' END FROM products WHERE price IS NOT NULL),
kv AS (SELECT t.query_id, t.parent_asin, v.facet, {S.normalized('v.value')} AS value
  FROM top100 t JOIN grp USING (query_id) JOIN allv v ON v.parent_asin = t.parent_asin JOIN reg r ON r.question_group = grp.question_group AND r.facet = v.facet AND r.source = v.source),
vc AS (SELECT query_id, facet, value, count(*)::BIGINT AS n FROM kv GROUP BY ALL),
rec AS (SELECT * FROM vc WHERE n >= 2),
util AS (
  SELECT query_id, facet, round(sum(n) / any_value(candidates)::DOUBLE, 9) AS answerability, any_value(candidates) AS candidates,
         round(sum(n) / any_value(candidates)::DOUBLE * ((ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*))) * least(1.0::DOUBLE, sqrt(8.0::DOUBLE / count(*))), 9) AS discrimination
  FROM rec JOIN n100 USING (query_id) GROUP BY ALL HAVING count(*) >= 2),
nov AS (
  SELECT query_id, facet, 1 - sum(CASE WHEN len(words) > 0 AND len(list_filter(words, lambda w: NOT list_contains(known, w))) = 0 THEN n ELSE 0 END) / sum(n)::DOUBLE AS novelty
  FROM (SELECT r.*, list_distinct({S.terms('value')}) AS words, list_distinct({S.terms('category')}) AS known FROM rec r JOIN queries USING (query_id)) GROUP BY ALL),
enough AS (SELECT query_id, facet FROM kv GROUP BY ALL HAVING count(*) >= 5),
told AS (
  SELECT DISTINCT query_id, facet FROM (SELECT query_id, facet, list_distinct({S.terms('value')}) AS v FROM vc) JOIN
    (SELECT query_id, list_distinct({S.terms('constraint_text')}) AS c FROM queries WHERE constraint_text IS NOT NULL) USING (query_id)
  WHERE len(v) > 0 AND len(c) > 0 AND (len(list_filter(v, lambda w: NOT list_contains(c, w))) = 0 OR len(list_filter(c, lambda w: NOT list_contains(v, w))) = 0)
  UNION SELECT query_id, 'budget' FROM queries WHERE budget_max IS NOT NULL),
asked AS (SELECT query_id, CASE WHEN length(category) % 2 = 0 THEN ['color', 'size_fit'] ELSE [] END AS asked,
  CASE WHEN length(category) % 3 = 0 THEN ['brand'] ELSE [] END AS asked_public, CASE WHEN length(category) % 5 = 0 THEN ['closure'] ELSE [] END AS declined,
  CASE WHEN length(category) % 4 = 0 THEN ['size_fit'] ELSE [] END AS follow_up, CASE WHEN intent = 'browsing' THEN ['feature'] ELSE [] END AS hints FROM queries),
facts AS (
  SELECT query_id, facet, family, public_attribute, position, prior, candidates, answerability, discrimination, novelty,
         CASE WHEN list_contains(hints, family) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hinted, list_contains(asked, facet) OR list_contains(asked_public, public_attribute) AS old,
         CASE WHEN old THEN 1 ELSE 0 END AS stage
  FROM util JOIN nov USING (query_id, facet) JOIN enough USING (query_id, facet) JOIN grp USING (query_id) JOIN reg USING (question_group, facet) JOIN asked USING (query_id)
  LEFT JOIN (SELECT *, true AS said FROM told) USING (query_id, facet)
  WHERE novelty > 0 AND NOT list_contains(declined, facet) AND (list_contains(follow_up, facet) OR (NOT old AND said IS NULL))),{_choice_sql(1)},{
  _choice_sql(2, "NOT EXISTS (SELECT 1 FROM chosen1 c WHERE c.query_id = f.query_id AND c.facet = f.facet)")}"""


@query("fine_facet_questions", f"WITH {FACETS} SELECT * FROM chosen1 UNION ALL SELECT * FROM chosen2")
def fine_facet_questions(spark, sf_dir):
    """The two best fine facets of every opening request; what was asked and answered before is told by the category's length."""
    queries, products = N.opening_queries(spark, sf_dir), N.part_products(spark, sf_dir)
    listed = lambda every, *names: F.when(F.length("category") % every == 0, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    state = queries.select(
        "query_id", "category", "budget_max", listed(2, "color", "size_fit").alias("asked"), listed(3, "brand").alias("asked_public"),
        listed(5, "closure").alias("no_preference"), listed(4, "size_fit").alias("follow_up"),
        F.when(F.col("intent") == "browsing", F.array(F.lit("feature"))).otherwise(F.array().cast("array<string>")).alias("profile_tags"))
    candidates, registry = SQ.top100(spark, sf_dir).select("query_id", "parent_asin"), FA.facet_registry(spark)
    groups = FA.dominant_group(candidates, products)
    values = FA.facet_values(candidates, EX.primary(spark, sf_dir), products, registry, groups)
    constraints = queries.select("query_id", F.explode("constraints").alias("text"))
    return FA.select_two_facets(values, groups, state, constraints, registry)
