"""Catalog profiles, evaluation reports and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import vocab as V
from lodestone.operators import evaluation as E
from lodestone.operators import profile as P
from lodestone.operators import sampling as G
from lodestone.operators import scoring as SC
from lodestone.plans import inputs as N
from lodestone.plans import sql as S
from lodestone.plans.registry import query
from lodestone.plans.scoring_queries import RANK_ORDER, components_sql
from lodestone.plans.search_queries import CANDIDATES
from lodestone.plans.text_queries import FREQUENCY_SQL, PURCHASES, STYLE_SQL, _classify_sql
from lodestone.sources import adapters as A


def _paths(spark, sf_dir):
    return P.path_counts(A.part_catalog(spark, sf_dir))


NODES = f"""{S.PART_CATALOG},
lab AS (SELECT categories, unnest(categories) AS label, generate_subscripts(categories, 1) AS depth FROM catalog)"""


@query("taxonomy_levels", f"""WITH {NODES}
SELECT depth, count(DISTINCT label)::BIGINT AS unique_labels, count(DISTINCT categories[1:depth])::BIGINT AS unique_nodes, count(*)::BIGINT AS products
FROM lab GROUP BY depth""")
def taxonomy_levels(spark, sf_dir):
    return P.taxonomy_levels(_paths(spark, sf_dir))


@query("taxonomy_summary", f"""WITH {NODES}
SELECT (SELECT count(*) FROM catalog)::BIGINT AS products, 0::BIGINT AS products_without_categories,
       (SELECT count(DISTINCT categories[3]) FROM catalog)::BIGINT AS leaf_labels, (SELECT count(DISTINCT categories) FROM catalog)::BIGINT AS leaf_nodes,
       (SELECT count(DISTINCT categories[2]) FROM catalog)::BIGINT AS penultimate_labels,
       (SELECT count(DISTINCT categories[1:2]) FROM catalog)::BIGINT AS penultimate_nodes,
       (SELECT count(DISTINCT categories[1:depth]) FROM lab)::BIGINT AS taxonomy_nodes""")
def taxonomy_summary(spark, sf_dir):
    return P.taxonomy_summary(_paths(spark, sf_dir))


@query("taxonomy_depths", f"WITH {S.PART_CATALOG} SELECT len(categories) AS depth, count(*)::BIGINT AS products FROM catalog GROUP BY 1")
def taxonomy_depths(spark, sf_dir):
    return P.depth_histogram(_paths(spark, sf_dir))


@query("taxonomy_top_labels", f"""WITH {NODES},
c AS (SELECT depth, label, count(*)::BIGINT AS products FROM lab GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY products DESC, label) AS place FROM c) WHERE place <= 5""")
def taxonomy_top_labels(spark, sf_dir):
    return P.top_labels(_paths(spark, sf_dir), 5)


@query("department_audit", f"""WITH {S.PART_CATALOG}
SELECT count(*)::BIGINT AS with_second_level, count(*) FILTER (categories[2] IN ({S.quoted(V.DEPARTMENT_LABELS)}))::BIGINT AS department_products,
       count(DISTINCT categories[2])::BIGINT AS other_labels, 0.0::DOUBLE AS department_fraction, false AS always_department FROM catalog""")
def department_audit(spark, sf_dir):
    return P.department_audit(_paths(spark, sf_dir))


@query("field_missingness", f"""WITH {S.PRODUCTS},
m AS (SELECT count(*)::BIGINT AS rows, unnest([
    {{'f': 'material', 'm': count(*) FILTER (material IS NULL)}}, {{'f': 'color', 'm': count(*) FILTER (color IS NULL)}},
    {{'f': 'price', 'm': count(*) FILTER (price IS NULL)}}, {{'f': 'brand', 'm': count(*) FILTER (brand IS NULL)}},
    {{'f': 'category_terms', 'm': count(*) FILTER (len(category_terms) = 0)}}]) AS x FROM products)
SELECT x.f AS field, rows, x.m::BIGINT AS missing, (rows - x.m)::BIGINT AS present FROM m""")
def field_missingness(spark, sf_dir):
    rows = P.field_missingness(N.part_products(spark, sf_dir).select("material", "color", "price", "brand", "category_terms"))
    return rows.select("field", "rows", "missing", "present")


def summary_sql(values: str) -> str:
    picks = ", ".join(
        f"max(value) FILTER (i = round_even({f}::DOUBLE * (n - 1), 0) + 1) AS {name}" for name, f in P.FRACTIONS.items())
    return f"""
vals AS ({values}),
ord AS (SELECT measure, value, row_number() OVER (PARTITION BY measure ORDER BY value) AS i, count(*) OVER (PARTITION BY measure) AS n FROM vals)
SELECT measure, count(*)::BIGINT AS count, round(sum(value) / count(*), 3) AS mean, min(value) AS min, {picks}, max(value) AS max
FROM ord GROUP BY measure"""


@query("text_length_percentiles", f"""WITH {S.PART_CATALOG},
{summary_sql(f'''SELECT x.m AS measure, x.v::DOUBLE AS value FROM (SELECT unnest([
  {{'m': 'title', 'v': length(title)}}, {{'m': 'features', 'v': length(array_to_string(features, ' '))}}, {{'m': 'details', 'v': length({S.DETAILS_TEXT})}},
  {{'m': 'description', 'v': length(array_to_string(description, ' '))}}, {{'m': 'categories', 'v': length(array_to_string(categories, ' '))}},
  {{'m': 'store', 'v': length(store)}}]) AS x FROM catalog)''')}""")
def text_length_percentiles(spark, sf_dir):
    return P.nearest_rank_summary(P.text_lengths(A.part_catalog(spark, sf_dir)))


@query("price_percentiles", f"""WITH {summary_sql("SELECT l_returnflag AS measure, l_extendedprice AS value FROM lineitem")}""")
def price_percentiles(spark, sf_dir):
    return P.nearest_rank_summary(A.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("measure"), F.col("l_extendedprice").alias("value")))


@query("detail_key_coverage", f"""WITH {S.PART_CATALOG}
SELECT 'clothing' AS category_group, d.k AS key, count(*)::BIGINT AS products, round(count(*) / (SELECT count(*) FROM catalog)::DOUBLE, 9) AS share
FROM (SELECT unnest(details) AS d FROM catalog) GROUP BY 2""")
def detail_key_coverage(spark, sf_dir):
    return P.detail_key_coverage(A.part_catalog(spark, sf_dir))


@query("detail_group_coverage", f"""WITH {S.PART_CATALOG},
e AS (SELECT parent_asin, lower(d.k) AS detail_group, lower(d.v) AS value FROM (SELECT parent_asin, unnest(details) AS d FROM catalog)),
c AS (SELECT detail_group, value, count(*)::BIGINT AS n FROM e GROUP BY ALL)
SELECT * FROM (SELECT detail_group, value, n, row_number() OVER (PARTITION BY detail_group ORDER BY n DESC, value) AS place,
  (SELECT count(DISTINCT parent_asin) FROM e WHERE e.detail_group = c.detail_group)::BIGINT AS covered,
  count(*) OVER (PARTITION BY detail_group) AS distinct_values FROM c) WHERE place <= 8""")
def detail_group_coverage(spark, sf_dir):
    return P.detail_group_coverage(A.part_catalog(spark, sf_dir))


@query("evidence_counts", "WITH t AS (SELECT " + S.FIRST_LINE + " || ' ' || text || ' Language: ' || lang AS t FROM documents) " + " UNION ALL ".join(
    f"SELECT 'clothing' AS category_group, '{n}' AS evidence, count(*) FILTER (regexp_matches(t, '(?i){p}'))::BIGINT AS products FROM t"
    for n, p in P.EVIDENCE_PATTERNS.items()))
def evidence_counts(spark, sf_dir):
    return P.evidence_counts(A.document_catalog(spark, sf_dir))


@query("category_cardinality", f"""WITH {S.PART_CATALOG}
SELECT count(DISTINCT categories)::BIGINT AS paths, count(DISTINCT categories[3])::BIGINT AS leaves,
       count(DISTINCT categories[2] || ' ' || categories[3])::BIGINT AS coarse FROM catalog""")
def category_cardinality(spark, sf_dir):
    return P.category_cardinality(A.part_catalog(spark, sf_dir))


TARGETS = "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS parent_asin FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.1"


def _targets(spark, sf_dir):
    line = A.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_discount >= 0.1")
    return line.select(F.col("l_partkey").cast("string").alias("parent_asin")).distinct()


@query("candidate_pool_sizes", f"""WITH {S.PART_CATALOG}, targets AS ({TARGETS}),
k AS (SELECT parent_asin, count(*) OVER (PARTITION BY categories) AS a, count(*) OVER (PARTITION BY categories[3]) AS b FROM catalog),
{summary_sql('''SELECT x.m AS measure, x.v::DOUBLE AS value FROM (SELECT unnest([{'m': 'full_path', 'v': a}, {'m': 'leaf', 'v': b}, {'m': 'coarse', 'v': a}]) AS x
  FROM k JOIN targets USING (parent_asin))''')}""")
def candidate_pool_sizes(spark, sf_dir):
    return P.nearest_rank_summary(P.pool_sizes(A.part_catalog(spark, sf_dir), _targets(spark, sf_dir)))


@query("price_coverage_by_leaf", f"""WITH {S.PART_CATALOG}
SELECT categories[3] AS leaf, count(*)::BIGINT AS products, count(*) FILTER (price <> '—')::BIGINT AS priced,
       round(count(*) FILTER (price <> '—') / count(*)::DOUBLE, 9) AS share FROM catalog GROUP BY 1""")
def price_coverage_by_leaf(spark, sf_dir):
    return P.price_coverage_by_leaf(A.part_catalog(spark, sf_dir))


@query("price_kinds", f"""WITH {S.PART_CATALOG}
SELECT CASE WHEN price LIKE 'from %' THEN 'lower_bound' WHEN price = '—' THEN 'missing' ELSE 'exact' END AS kind, count(*)::BIGINT AS products
FROM catalog GROUP BY 1""")
def price_kinds(spark, sf_dir):
    return P.price_kinds(A.part_catalog(spark, sf_dir))


@query("catalog_versus_targets", f"""WITH {S.PRODUCTS}, targets AS ({TARGETS}),
{summary_sql('''SELECT x.m AS measure, x.v::DOUBLE AS value FROM (
  SELECT unnest([{'m': 'catalog.average_rating', 'v': average_rating}, {'m': 'catalog.rating_number', 'v': rating_number::DOUBLE}, {'m': 'catalog.price', 'v': price}]) AS x FROM products
  UNION ALL SELECT unnest([{'m': 'targets.average_rating', 'v': average_rating}, {'m': 'targets.rating_number', 'v': rating_number::DOUBLE}, {'m': 'targets.price', 'v': price}])
  FROM products JOIN targets USING (parent_asin)) WHERE x.v IS NOT NULL''')}""")
def catalog_versus_targets(spark, sf_dir):
    return P.nearest_rank_summary(P.population_measures(A.part_catalog(spark, sf_dir), _targets(spark, sf_dir)))


@query("document_statistics", """
SELECT count(*)::BIGINT AS documents, round(avg(length(text)), 2) AS mean_chars, max(length(text)) AS max_chars, sum(length(text))::BIGINT AS total_chars,
       round(avg(w), 2) AS mean_words, max(w) AS max_words, sum(w)::BIGINT AS total_words
FROM (SELECT text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM documents)""")
def document_statistics(spark, sf_dir):
    return P.document_statistics(A.table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- evaluation over recorded logs

# Sessions are customers, turns their orders, recommendations the parts of the order; the target is the part a
# customer bought most often.
LOG = """
ord AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS turn FROM orders),
recs AS (SELECT o_custkey, turn, l_partkey, row_number() OVER (PARTITION BY o_custkey, turn ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos
         FROM ord JOIN lineitem ON l_orderkey = o_orderkey),
firsts AS (SELECT o_custkey, turn, l_partkey, min(pos) AS pos FROM recs GROUP BY ALL),
norm AS (SELECT CAST(o_custkey AS VARCHAR) AS session_id, turn, CAST(l_partkey AS VARCHAR) AS parent_asin, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, turn ORDER BY pos) AS rank FROM firsts) WHERE rank <= 10),
bought AS (SELECT o_custkey, l_partkey, count(*) AS n FROM recs GROUP BY ALL),
lab AS (SELECT CAST(c_custkey AS VARCHAR) AS session_id,
          CASE c_mktsegment WHEN 'BUILDING' THEN 'intent_override' WHEN 'AUTOMOBILE' THEN 'browsing' WHEN 'MACHINERY' THEN 'boundary' ELSE 'buying' END AS scenario_type,
          CAST(target AS VARCHAR) AS target, CASE WHEN c_mktsegment = 'BUILDING' THEN 3 END AS override_turn
  FROM customer JOIN (SELECT o_custkey, l_partkey AS target, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, l_partkey) AS k FROM bought) b
    ON b.o_custkey = c_custkey AND k = 1),
hits AS (SELECT session_id, min(turn) AS first_hit_turn, arg_min(rank, turn) AS best_rank FROM norm JOIN lab USING (session_id)
         WHERE parent_asin = target AND turn <= 10 AND turn >= coalesce(override_turn, 1) GROUP BY 1),
outcomes AS (SELECT session_id, scenario_type, first_hit_turn IS NOT NULL AS hit, first_hit_turn, best_rank,
             coalesce(1.0::DOUBLE / best_rank, 0) AS reciprocal_rank FROM lab LEFT JOIN hits USING (session_id))"""


def _log(spark, sf_dir):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = A.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("turn", F.row_number().over(order))
    lines = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    joined = orders.join(lines, orders.o_orderkey == lines.l_orderkey)
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    listed = joined.groupBy("o_custkey", "turn").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    log = listed.select(
        F.col("o_custkey").cast("string").alias("session_id"), "turn",
        F.transform("e", lambda x: x["l_partkey"].cast("string")).alias("recommendations"))
    counts = joined.groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("n"))
    targets = counts.groupBy("o_custkey").agg(F.min_by("l_partkey", F.struct((-F.col("n")).alias("k"), F.col("l_partkey").alias("p"))).alias("target"))
    customers = A.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    scenario = F.when(F.col("c_mktsegment") == "BUILDING", "intent_override").when(F.col("c_mktsegment") == "AUTOMOBILE", "browsing").when(
        F.col("c_mktsegment") == "MACHINERY", "boundary").otherwise("buying")
    labels = customers.join(targets, customers.c_custkey == targets.o_custkey).select(
        F.col("c_custkey").cast("string").alias("session_id"), scenario.alias("scenario_type"), F.col("target").cast("string").alias("target"),
        F.when(F.col("c_mktsegment") == "BUILDING", 3).alias("override_turn"))
    catalog = A.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("parent_asin"))
    return log, labels, catalog


def _outcomes(spark, sf_dir):
    log, labels, catalog = _log(spark, sf_dir)
    return E.session_outcomes(E.normalize_recommendations(log, catalog), labels)


@query("normalize_recommendations", f"WITH {LOG} SELECT session_id, turn, parent_asin, rank FROM norm")
def normalize_recommendations(spark, sf_dir):
    log, _, catalog = _log(spark, sf_dir)
    return E.normalize_recommendations(log, catalog)


@query("session_outcomes", f"WITH {LOG} SELECT session_id, scenario_type, hit, first_hit_turn, best_rank, round(reciprocal_rank, 9) AS reciprocal_rank FROM outcomes")
def session_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir).withColumn("reciprocal_rank", F.round("reciprocal_rank", 9))


METRIC_COLUMNS = """count(*)::BIGINT AS sample_count, round(avg(hit::INT), 6) AS hit_rate_at_10, round(avg(reciprocal_rank), 6) AS mrr,
  round(avg(coalesce(first_hit_turn, 11)), 6) AS mttc"""
WITH_SCORE = """*, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (11.0 - mttc) / 10.0)), 6) AS efficiency,
  round(0.50::DOUBLE * hit_rate_at_10 + 0.30::DOUBLE * mrr + 0.20::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (11.0 - mttc) / 10.0)), 6) AS score"""


@query("metric_summary", f"WITH {LOG}, m AS (SELECT {METRIC_COLUMNS} FROM outcomes) SELECT {WITH_SCORE} FROM m")
def metric_summary(spark, sf_dir):
    return E.metric_summary(_outcomes(spark, sf_dir))


@query("metric_report", f"""WITH {LOG}, m AS (
  SELECT scenario_type, {METRIC_COLUMNS} FROM outcomes GROUP BY 1 UNION ALL SELECT 'all', {METRIC_COLUMNS} FROM outcomes)
SELECT {WITH_SCORE} FROM m""")
def metric_report(spark, sf_dir):
    return E.metric_report(_outcomes(spark, sf_dir))


@query("session_objective", f"""WITH {LOG}
SELECT scenario_type, round(avg(CASE WHEN hit THEN 0.5::DOUBLE + 0.3::DOUBLE * reciprocal_rank + 0.2::DOUBLE * (11 - first_hit_turn) / 10.0 ELSE 0.0::DOUBLE END), 9) AS objective
FROM outcomes GROUP BY 1""")
def session_objective(spark, sf_dir):
    return E.session_objective(_outcomes(spark, sf_dir), "scenario_type")


@query("token_totals", """SELECT sum(length(text)) FILTER (role = 'user')::BIGINT AS prompt_tokens, sum(length(text)) FILTER (role <> 'user')::BIGINT AS completion_tokens,
  sum(length(text))::BIGINT AS total_tokens FROM conversations""")
def token_totals(spark, sf_dir):
    usage = A.table(spark, sf_dir, "conversations").select(
        F.when(F.col("role") == "user", F.length("text")).otherwise(-1).alias("prompt_tokens"),
        F.when(F.col("role") != "user", F.length("text")).alias("completion_tokens"))
    return E.token_totals(usage)


SWEEP_CONFIGS = {
    "default": SC.ScoringConfig(),
    "heavy_price": SC.ScoringConfig(price_weight=0.4),
    "shrunk": SC.ScoringConfig(bayesian_confidence_scale=4.0),
}


# The stronger pull towards the mean changes one component only: the tail of the default SQL over another rating column.
_TAIL = components_sql(scale="4.0")
SHRUNK = "comp_shrunk AS (" + _TAIL[_TAIL.index("comp AS (") + 9:].replace("FROM comp)", "FROM comp_shrunk)").replace("FROM blend)", "FROM blend_shrunk)").replace(
    "blend AS (", "blend_shrunk AS (").replace("scored AS (", "scored_shrunk AS (")


@query("weight_sweep", f"""WITH {CANDIDATES}, {components_sql().replace('scored AS (', 'scored_default AS (')},
{SHRUNK},
all_scored AS (
  SELECT 'default' AS config_id, query_id, parent_asin, lexical_rank, score FROM scored_default
  UNION ALL SELECT 'heavy_price', query_id, parent_asin, lexical_rank,
    round(CASE WHEN budget_max IS NOT NULL THEN (1 - 0.4::DOUBLE) * ordinary + 0.4::DOUBLE * price_fit ELSE ordinary END, 9) FROM blend
  UNION ALL SELECT 'shrunk', query_id, parent_asin, lexical_rank, score FROM scored_shrunk),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config_id, query_id ORDER BY {RANK_ORDER}) AS rank FROM all_scored) WHERE rank <= 10),
qlab AS (SELECT intent || '|' || category || '|' || coalesce(constraint_text, '') AS query_id, target AS parent_asin FROM opened),
grid AS (SELECT config_id, query_id, parent_asin FROM qlab, (SELECT DISTINCT config_id FROM all_scored)),
o AS (SELECT config_id, rank IS NOT NULL AS hit, CASE WHEN rank IS NOT NULL THEN 1 END AS first_hit_turn, coalesce(1.0::DOUBLE / rank, 0) AS reciprocal_rank
      FROM grid LEFT JOIN best USING (config_id, query_id, parent_asin)),
m AS (SELECT config_id, {METRIC_COLUMNS} FROM o GROUP BY 1), f AS (SELECT {WITH_SCORE} FROM m)
SELECT *, row_number() OVER (ORDER BY score DESC, config_id) AS place FROM f""")
def weight_sweep(spark, sf_dir):
    return E.sweep(
        N.opening_lexical(spark, sf_dir), N.opening_queries(spark, sf_dir), N.part_products(spark, sf_dir), N.part_stats(spark, sf_dir),
        SWEEP_CONFIGS, N.session_openings(spark, sf_dir).select("query_id", "target"))


# ---------------------------------------------------------------- samples

def u_sql(seed: int, *columns: str) -> str:
    joined = " || '|' || ".join([f"'{seed}'", *columns])
    return f"((('0x' || substr(md5({joined}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE)"


GROUPS = f"""{PURCHASES},
records AS (SELECT * FROM purchases WHERE parent_asin NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size = 50))"""


def _records(spark, sf_dir):
    catalog = A.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("parent_asin"))
    excluded = A.table(spark, sf_dir, "part").filter("p_size = 50").select(F.col("p_partkey").cast("string").alias("parent_asin"))
    return G.record_groups(A.purchases(spark, sf_dir), catalog, excluded)


@query("record_groups", f"WITH {GROUPS} SELECT parent_asin, count(*)::BIGINT AS records, round(avg(rating), 9) AS mean_rating FROM records GROUP BY 1")
def record_groups(spark, sf_dir):
    return _records(spark, sf_dir).groupBy("parent_asin").agg(
        F.count("*").alias("records"), F.round(F.avg("rating"), 9).alias("mean_rating"))


@query("weighted_sample", f"""WITH {GROUPS}, w AS (SELECT parent_asin, count(*)::BIGINT AS weight FROM records GROUP BY 1)
SELECT * FROM (SELECT parent_asin, weight, row_number() OVER (ORDER BY -ln({u_sql(7, 'parent_asin')}) / weight, parent_asin) AS position FROM w) WHERE position <= 100""")
def weighted_sample(spark, sf_dir):
    return G.weighted_sample(_records(spark, sf_dir), 100, 7)


@query("group_balanced_sample", f"""WITH {S.PART_CATALOG},
r AS (SELECT parent_asin, array_to_string(categories, chr(1)) AS path, {u_sql(3, 'parent_asin')} AS u FROM catalog),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY u, parent_asin) AS leaf_rank FROM r) WHERE leaf_rank <= 3)
SELECT parent_asin, 'clothing' AS category_group, path, leaf_rank, group_rank FROM (
  SELECT *, row_number() OVER (ORDER BY u, parent_asin) AS group_rank FROM c) WHERE group_rank <= 40""")
def group_balanced_sample(spark, sf_dir):
    return G.group_balanced_sample(A.part_catalog(spark, sf_dir), 40, 3, 3)


@query("stratified_split", f"""WITH r AS (SELECT CAST(p_partkey AS VARCHAR) AS parent_asin, p_type AS stratum FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {u_sql(11, 'parent_asin')}, parent_asin) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM r)
SELECT parent_asin, stratum, CASE WHEN (k - 0.5) / n < 0.70 THEN 'train' WHEN (k - 0.5) / n < 0.85 THEN 'validation' ELSE 'test' END AS split FROM o""")
def stratified_split(spark, sf_dir):
    parts = A.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("parent_asin"), F.col("p_type").alias("stratum"))
    return G.stratified_split(parts, "stratum", 11)


@query("balanced_targets", f"""WITH r AS (SELECT CAST(p_partkey AS VARCHAR) AS parent_asin FROM part),
o AS (SELECT *, row_number() OVER (ORDER BY {u_sql(5, 'parent_asin')}, parent_asin) AS k, (SELECT count(*) FROM orders) AS m, count(*) OVER () AS n FROM r),
c AS (SELECT parent_asin, (m // n + CASE WHEN k <= m % n THEN 1 ELSE 0 END)::BIGINT AS uses FROM o)
SELECT parent_asin, unnest(generate_series(1, uses)) AS repeat_no FROM c""")
def balanced_targets(spark, sf_dir):
    parts = A.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("parent_asin"))
    return G.balanced_targets(parts, A.table(spark, sf_dir, "orders").count(), 5)


@query("unique_first_sessions", f"""WITH {S.TURNS},
s AS (SELECT session_id || ':' || turn AS sample_id, target FROM turns),
r AS (SELECT *, {u_sql(9, 'sample_id')} AS u FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY u, sample_id) AS repeat_no FROM r)
SELECT * FROM (SELECT sample_id, target, repeat_no, row_number() OVER (ORDER BY repeat_no + u, sample_id) AS position FROM k) WHERE position <= 500""")
def unique_first_sessions(spark, sf_dir):
    turns = A.shopping_turns(spark, sf_dir).select(
        F.concat_ws(":", "session_id", F.col("turn").cast("string")).alias("sample_id"), "target")
    return G.unique_first_sessions(turns, 500, 9)


@query("split_leaks", f"""WITH {S.TURNS}, s AS (SELECT DISTINCT target, CASE WHEN turn <= 3 THEN 'train' WHEN turn <= 6 THEN 'validation' ELSE 'test' END AS split FROM turns)
SELECT target, string_agg(split, ' and ' ORDER BY split) AS splits FROM s GROUP BY 1 HAVING count(*) > 1""")
def split_leaks(spark, sf_dir):
    split = F.when(F.col("turn") <= 3, "train").when(F.col("turn") <= 6, "validation").otherwise("test")
    return E.split_leaks(A.shopping_turns(spark, sf_dir).select(split.alias("split"), "target"))


@query("run_signature", f"""WITH {S.TURNS},
s AS (SELECT CASE WHEN turn <= 3 THEN 'train' ELSE 'test' END AS split, md5(session_id || ':' || turn) AS d FROM turns),
l AS (SELECT split || ':' || count(*) || ':' || sum(('0x' || substr(d, 1, 12))::HUGEINT) || ':' || sum(('0x' || substr(d, 13, 12))::HUGEINT) AS line FROM s GROUP BY split)
SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS signature FROM l""")
def run_signature(spark, sf_dir):
    rows = A.shopping_turns(spark, sf_dir).select(
        F.when(F.col("turn") <= 3, "train").otherwise("test").alias("split"),
        F.concat_ws(":", "session_id", F.col("turn").cast("string")).alias("sample_id"))
    return E.run_signature(rows)


CARDS = f"""{S.PART_CATALOG},
flat AS (SELECT *, list_concat(features, list_transform(details, lambda d: d.k || ': ' || d.v)) AS f, {S.first_word('title', V.COLORS)} AS color FROM catalog),
items AS (SELECT parent_asin, title, list_concat(CASE WHEN color IS NULL THEN f ELSE list_concat(list_concat(f[1:1], ['color: ' || color]), f[2:]) END,
                 ['budget around $' || price]) AS c FROM flat),
seq AS (SELECT parent_asin, title, rtrim(substr(trim(unnest(c), ' -;,.'), 1, 180)) AS v, generate_subscripts(c, 1) AS i FROM items),
firsts AS (SELECT parent_asin, title, v, min(i) AS i FROM seq WHERE v <> '' GROUP BY ALL),
num AS (SELECT *, row_number() OVER (PARTITION BY parent_asin ORDER BY i) AS n FROM firsts),
cards AS (SELECT parent_asin, any_value(title) AS target_category, list(v ORDER BY n) FILTER (n <= 2) AS hard, list(v ORDER BY n) FILTER (n IN (3, 4)) AS soft
          FROM num GROUP BY 1)"""


@query("constraint_cards", f"""WITH {CARDS}
SELECT parent_asin, target_category, array_to_string(hard, ' | ') AS hard_constraints, array_to_string(soft, ' | ') AS soft_preferences FROM cards""")
def constraint_cards(spark, sf_dir):
    return G.constraint_cards(A.part_catalog(spark, sf_dir)).select(
        "parent_asin", "target_category", F.array_join("hard_constraints", " | ").alias("hard_constraints"),
        F.array_join("soft_preferences", " | ").alias("soft_preferences"))


_KIND = lambda v: _classify_sql(f"lower({v})")


@query("constraint_type_distribution", f"""WITH {CARDS},
h AS (SELECT parent_asin, unnest(hard) AS v, generate_subscripts(hard, 1) AS i FROM cards), s AS (SELECT parent_asin, unnest(soft) AS v FROM cards),
hk AS (SELECT parent_asin, i, {_KIND('v')} AS k FROM h), sk AS (SELECT parent_asin, {_KIND('v')} AS k FROM s),
u AS (SELECT DISTINCT parent_asin, k FROM (SELECT parent_asin, k FROM hk UNION ALL SELECT parent_asin, k FROM sk))
SELECT distribution, label, count(*)::BIGINT AS cards FROM (
  SELECT 'hard' AS distribution, k AS label FROM hk UNION ALL SELECT 'soft', k FROM sk UNION ALL SELECT 'first_hard', k FROM hk WHERE i = 1
  UNION ALL SELECT 'any', k FROM u UNION ALL SELECT 'distinct_types', CAST(count(*) AS VARCHAR) FROM u GROUP BY parent_asin) GROUP BY ALL""")
def constraint_type_distribution(spark, sf_dir):
    return G.constraint_type_distribution(G.constraint_cards(A.part_catalog(spark, sf_dir)))


TEMPLATES = """
tpl AS (SELECT r_regionkey AS template_no, CASE r_regionkey WHEN 0 THEN ['comfort', 'fit'] WHEN 1 THEN ['material'] WHEN 2 THEN ['durability', 'weather']
        WHEN 3 THEN ['style'] ELSE ['performance', 'warmth'] END AS tags FROM region)"""


def _templates(spark, sf_dir):
    words = {0: ("comfort", "fit"), 1: ("material",), 2: ("durability", "weather"), 3: ("style",), 4: ("performance", "warmth")}
    table = F.create_map(*[x for k, v in words.items() for x in (F.lit(k), X._words(v))])
    return A.table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("bigint").alias("template_no"), F.element_at(table, F.col("r_regionkey")).alias("preference_tags"))


SESSIONS = f"""{GROUPS}, {TEMPLATES},
w AS (SELECT parent_asin, count(*)::BIGINT AS weight FROM records GROUP BY 1),
drawn AS (SELECT * FROM (SELECT parent_asin, row_number() OVER (ORDER BY -ln({u_sql(7, 'parent_asin')}) / weight, parent_asin) AS position FROM w) WHERE position <= 100),
placed AS (SELECT *, row_number() OVER (ORDER BY {u_sql(7, 'parent_asin', "'scenario'")}, parent_asin) AS place FROM drawn),
chosen AS (SELECT * FROM (SELECT parent_asin, rating, history, row_number() OVER (PARTITION BY parent_asin
  ORDER BY {u_sql(7, 'parent_asin', 'user_id', 'CAST(rating AS VARCHAR)', 'history')}, rating, history) AS k FROM records) WHERE k = 1),
sessions AS (
  SELECT 'generated_' || lpad(CAST(position AS VARCHAR), 4, '0') AS sample_id, p.parent_asin,
    CASE WHEN place <= 40 THEN 'buying' WHEN place <= 80 THEN 'browsing' WHEN place <= 95 THEN 'intent_override' ELSE 'boundary' END AS scenario_type,
    CASE WHEN place <= 40 THEN 'easy' WHEN place <= 80 THEN 'medium' WHEN place <= 95 THEN 'hard' ELSE 'medium' END AS difficulty_bucket,
    'clothing' AS category_bucket, rating, {FREQUENCY_SQL} AS frequency, {STYLE_SQL} AS style, tags
  FROM placed p JOIN chosen c ON c.parent_asin = p.parent_asin
  JOIN tpl ON template_no = floor({u_sql(7, 'p.parent_asin', "'tags'")} * 5)::BIGINT)"""


def _sessions(spark, sf_dir):
    return G.session_samples(_records(spark, sf_dir), A.part_catalog(spark, sf_dir), _templates(spark, sf_dir), 100, 7)


@query("session_samples", f"""WITH {SESSIONS}
SELECT sample_id, parent_asin, scenario_type, difficulty_bucket, category_bucket, rating, frequency, array_to_string(tags, ',') AS tags,
  'Prior purchases emphasize ' || array_to_string(tags, ', ') || '; ratings are ' || style || '.' AS summary FROM sessions""")
def session_samples(spark, sf_dir):
    return _sessions(spark, sf_dir).select(
        "sample_id", "ground_truth.parent_asin", "scenario_type", "difficulty_bucket", "category_bucket",
        F.col("user_profile.average_prior_rating").alias("rating"), F.col("user_profile.purchase_frequency").alias("frequency"),
        F.array_join("user_profile.preference_tags", ",").alias("tags"), F.col("user_profile.summary").alias("summary"))


@query("sample_distributions", f"""WITH {SESSIONS}
SELECT distribution, label, count(*)::BIGINT AS samples FROM (
  SELECT 'category' AS distribution, category_bucket AS label FROM sessions UNION ALL SELECT 'scenario', scenario_type FROM sessions
  UNION ALL SELECT 'rating_style', style FROM sessions UNION ALL SELECT 'preference_tag', unnest(tags) FROM sessions) GROUP BY ALL""")
def sample_distributions(spark, sf_dir):
    return G.sample_distributions(_sessions(spark, sf_dir))
