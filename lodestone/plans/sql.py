"""SQL fragments shared by the DuckDB statements that check the queries."""

from __future__ import annotations

from lodestone.functions import vocab as V


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def word_list(words) -> str:
    return "[" + quoted(words) + "]"


def terms(e: str, stop=V.STOPWORDS) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all({e}, '[a-zA-Z0-9]+'), lambda t: lower(t)), "
        f"lambda t: length(t) > 1 and t not in ({quoted(stop)}))"
    )


def index_tokens(e: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({e})), '[\\p{{L}}\\p{{N}}]+')"


def normalized(e: str) -> str:
    return f"lower(trim(regexp_replace({e}, '[\\s\\x{{00a0}}]+', ' ', 'g')))"


def first_word(e: str, words) -> str:
    return f"nullif(lower(regexp_extract({e}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(words)})($|[^\\p{{L}}\\p{{N}}_])', 2)), '')"


PART_CATALOG = """
sold AS (SELECT l_partkey, sum(CAST(round(l_discount * 100) AS BIGINT))::BIGINT AS cents, count(*)::BIGINT AS sold
         FROM lineitem GROUP BY 1),
catalog AS (
  SELECT CAST(p_partkey AS VARCHAR) AS parent_asin, p_name AS title,
         [p_brand, lower(p_type) || ' grade ' || p_name] AS features,
         ['A ' || p_name || ' of size ' || CAST(p_size AS VARCHAR)] AS description,
         CASE WHEN p_size % 5 = 0 THEN 'from ' || CAST(p_retailprice AS VARCHAR)
              WHEN p_size % 7 = 0 THEN '—' ELSE CAST(p_retailprice AS VARCHAR) END AS price,
         ['Parts', upper(p_type[1]) || lower(p_type[2:]),
          upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:]] AS categories,
         [{'k': 'Size', 'v': CAST(p_size AS VARCHAR)}, {'k': 'Brand', 'v': p_brand},
          {'k': 'Department', 'v': p_type}, {'k': 'Style', 'v': split_part(p_name, ' ', 1)}] AS details,
         greatest(1.0::DOUBLE, least(5.0::DOUBLE, 1 + 4 * (cents / (sold * 10.0::DOUBLE)))) AS average_rating,
         sold AS rating_number, p_brand AS store,
         p_size, p_type, p_brand, p_retailprice
  FROM part JOIN sold ON p_partkey = l_partkey)"""

DETAILS_TEXT = "array_to_string(list_transform(details, lambda d: d.k || ' ' || d.v), ' ')"

PRODUCTS = PART_CATALOG + f""",
products AS (
  SELECT parent_asin, title, array_to_string(description, ' ') AS description, categories AS category_path,
         categories[2] || ' ' || categories[3] AS coarse_category,
         lower(categories[2] || ' ' || categories[3]) AS category_key,
         list_distinct({terms("array_to_string(categories, ' ')")}) AS category_terms,
         list_distinct({terms("title || ' ' || array_to_string(features, ' ') || ' ' || " + DETAILS_TEXT + " || ' ' || array_to_string(description, ' ') || ' ' || array_to_string(categories, ' ') || ' ' || store")}) AS search_terms,
         average_rating, rating_number,
         CASE WHEN price LIKE 'from %' THEN CAST(substr(price, 6) AS DOUBLE) ELSE try_cast(price AS DOUBLE) END AS price,
         price LIKE 'from %' AS price_is_lower_bound,
         lower(p_type) AS department,
         NULL::VARCHAR AS material,
         {first_word("title", V.COLORS)} AS color,
         split_part(title, ' ', 1) AS style, CAST(p_size AS VARCHAR) AS size, lower(p_brand) AS brand,
         NULL::VARCHAR AS use_case, true AS has_features
  FROM catalog)"""

FIRST_LINE = "split_part(text, chr(10), 1)"

DOC_FIELDS = f"""SELECT CAST(doc_id AS VARCHAR) AS parent_asin, {FIRST_LINE} AS title, lang || ' ' || source AS categories,
  '' AS features, 'Language ' || lang AS details, source AS store, text AS description FROM documents"""
PART_FIELDS = f"""SELECT parent_asin, title, array_to_string(categories, ' ') AS categories, array_to_string(features, ' ') AS features,
  {DETAILS_TEXT} AS details, store, array_to_string(description, ' ') AS description FROM catalog"""


def index_ctes(fields: str) -> str:
    """Postings, lengths and statistics of an index over the given field texts."""
    tagged = ", ".join(f"{{'w': {V.BM25_WEIGHTS[f]}::DOUBLE, 't': {index_tokens(f)}}}" for f in V.BM25_FIELDS)
    return f"""
idx_fields AS ({fields}),
idx_tagged AS (SELECT parent_asin, unnest([{tagged}]) AS x FROM idx_fields),
idx_tokens AS (SELECT parent_asin, x.w AS w, unnest(x.t) AS term FROM idx_tagged),
postings AS (SELECT parent_asin, term, sum(w) AS wtf FROM idx_tokens GROUP BY ALL),
lens AS (SELECT parent_asin, count(*)::BIGINT AS doc_len FROM idx_tokens GROUP BY ALL),
totals AS (SELECT count(*)::BIGINT AS n, avg(doc_len) AS avg_len FROM lens),
stats AS (SELECT term, count(*)::BIGINT AS df,
                 greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf, any_value(n) AS n
          FROM postings, totals GROUP BY term)"""


def query_term_ctes(queries: str, limit: int, name: str = "qt", stop=V.STOPWORDS) -> str:
    """Distinct query terms in order of first use, cut to ``limit``."""
    return f"""
{name}_raw AS (SELECT query_id, {terms('query_text', stop)} AS ts FROM ({queries})),
{name}_seq AS (SELECT query_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM {name}_raw),
{name}_first AS (SELECT query_id, term, min(pos) AS pos FROM {name}_seq GROUP BY ALL),
{name}_num AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM {name}_first),
{name} AS (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS n_terms FROM {name}_num WHERE n <= {limit})"""


def score_ctes(name: str = "scores", qt: str = "qt") -> str:
    return f"""
{name} AS (
  SELECT query_id, p.parent_asin,
         round(sum(idf * (wtf * 2.2 / (wtf + 1.2 * (1 - 0.75 + 0.75 * doc_len / avg_len)))), 9) AS score,
         count(*) AS matched, any_value(n_terms) AS n_terms
  FROM {qt} JOIN postings p USING (term) JOIN stats USING (term) JOIN lens USING (parent_asin), totals GROUP BY ALL)"""


def topk_cte(name: str, k: int, scores: str = "scores", where: str = "true") -> str:
    return f"""
{name} AS (SELECT * FROM (
  SELECT query_id, parent_asin, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_asin) AS rank
  FROM {scores} WHERE {where}) WHERE rank <= {k})"""


BENCHMARK_QUERIES = "SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query_text FROM benchmark"
MESSAGE_QUERIES = (
    "SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn + 1 AS VARCHAR) AS query_id, text AS query_text "
    "FROM conversations WHERE role = 'user'")

# Shopping sessions: a customer's orders by tens, one turn per order.
TURNS = """
first_part AS (SELECT l_orderkey, min(l_partkey) AS p_partkey FROM lineitem GROUP BY 1),
numbered AS (
  SELECT o_custkey, o_orderpriority[1] AS u, p_name, p_brand, p_type, p_retailprice, part.p_partkey,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS number, number % 10 + 1 AS turn
  FROM orders JOIN first_part ON l_orderkey = o_orderkey JOIN part ON part.p_partkey = first_part.p_partkey),
worded AS (
  SELECT *, upper(p_type[1]) || lower(p_type[2:]) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS cat,
         split_part(p_name, ' ', 1) AS word, CAST(p_retailprice AS VARCHAR) AS price,
         ['material', 'color', 'style', 'size', 'budget', 'feature', 'use_case'][(turn - 2) % 7 + 1] AS asked
  FROM numbered),
turns AS (
  SELECT CAST(o_custkey AS VARCHAR) || '-' || CAST(number // 10 AS VARCHAR) AS session_id, turn, u, cat, word, price, p_brand, CAST(p_partkey AS VARCHAR) AS target,
    CASE WHEN turn > 1 THEN asked END AS last_asked_attribute,
    CASE WHEN turn = 1 THEN CASE u
      WHEN '1' THEN 'I''m looking for ' || cat || '. A key requirement is: ' || word || '.'
      WHEN '2' THEN 'I''m looking for ' || cat || ', but I''m still exploring.'
      WHEN '3' THEN 'I''m looking for ' || cat || '. ' || p_brand || ' ' || word
      WHEN '4' THEN 'I''m looking for ' || cat || '. A key requirement is: under $' || price || '.'
      ELSE cat END
    ELSE CASE
      WHEN u = '1' THEN 'Actually, ignore my earlier preference. What I need is: ' || word || '.'
      WHEN u IN ('2', '3') THEN 'For that, what matters is: ' || p_brand || '; budget around $' || price || '.'
      WHEN u = '4' THEN 'I don''t have a preference for ' || asked || '; please use your judgment.'
      ELSE 'Those options are not quite right yet. Ask me about one specific attribute.' END
    END AS message
  FROM worded)"""

# Distinct opening queries: the parsed first turns of all sessions.
OPENINGS = TURNS + """,
opened AS (
  SELECT session_id, target, CASE WHEN u = '2' THEN 'browsing' ELSE 'buying' END AS intent, cat AS category,
         CASE u WHEN '1' THEN word WHEN '3' THEN p_brand || ' ' || word WHEN '4' THEN 'under $' || price END AS constraint_text,
         u IN ('1', '4') AS hard, CASE WHEN u = '4' THEN CAST(price AS DOUBLE) END AS budget_max
  FROM turns WHERE turn = 1),
queries AS (
  SELECT DISTINCT intent || '|' || category || '|' || coalesce(constraint_text, '') AS query_id, intent, category, constraint_text, hard,
         budget_max, CASE WHEN constraint_text IS NULL THEN category ELSE category || ' ' || constraint_text END AS query_text
  FROM opened)"""
