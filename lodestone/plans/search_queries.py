"""Index building, lexical and vector retrieval, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import vocab as V
from lodestone.operators import fusion as U
from lodestone.operators import retrieval as R
from lodestone.operators import search_index as I
from lodestone.operators import vectors as D
from lodestone.plans import inputs as N
from lodestone.plans import sql as S
from lodestone.plans.registry import query
from lodestone.sources import adapters as A
from lodestone.sources import catalog as C

DOCS = S.index_ctes(S.DOC_FIELDS)


@query("index_postings", f"WITH {DOCS} SELECT parent_asin, term, wtf, doc_len FROM postings JOIN lens USING (parent_asin)")
def index_postings(spark, sf_dir):
    return I.build_postings(A.document_catalog(spark, sf_dir)).select("parent_asin", "term", "wtf", F.col("doc_len").cast("bigint").alias("doc_len"))


@query("index_term_stats", f"""WITH {DOCS}
SELECT term, df, round(idf, 9) AS bm25_idf, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS feature_idf,
       round(ln((n + 1) / (df + 1)) + 1, 9) AS ranker_idf FROM stats""")
def index_term_stats(spark, sf_dir):
    index = N.doc_index(spark, sf_dir)
    kinds = {"bm25": "bm25_idf", "feature": "feature_idf", "ranker": "ranker_idf"}
    n, df = F.col("doc_count"), F.col("df")
    formulas = {"bm25_idf": F.col("idf"), "feature_idf": F.log(1 + (n - df + 0.5) / (df + 0.5)), "ranker_idf": F.log((n + 1) / (df + 1)) + 1}
    return index.term_stats.crossJoin(F.broadcast(index.totals.select("doc_count"))).select(
        "term", "df", *[F.round(formulas[c], 9).alias(c) for c in kinds.values()])


@query("bm25_or_topk", f"""WITH {DOCS}, {S.query_term_ctes(S.BENCHMARK_QUERIES, 40)}, {S.score_ctes()}, {S.topk_cte('best', 10)}
SELECT query_id, parent_asin, score, rank FROM best""")
def bm25_or_topk(spark, sf_dir):
    best = R.bm25_topk(N.doc_index(spark, sf_dir), A.benchmark_queries(spark, sf_dir), V.TOP_K)
    return best


@query("bm25_broad_messages", f"""WITH {DOCS}, {S.query_term_ctes(S.MESSAGE_QUERIES, 50)}, {S.score_ctes()}, {S.topk_cte('best', 120)}
SELECT query_id, parent_asin, score, rank FROM best""")
def bm25_broad_messages(spark, sf_dir):
    best = R.bm25_topk(N.doc_index(spark, sf_dir), N.message_queries(spark, sf_dir), V.BROAD_LIMIT, limit=50)
    return best


@query("bm25_strict_topk", f"""WITH {S.PART_CATALOG}, {S.index_ctes(S.PART_FIELDS)}, {S.OPENINGS},
{S.query_term_ctes('SELECT query_id, query_text FROM queries', 16)}, {S.score_ctes()},
{S.topk_cte('best', 80, where='matched = n_terms AND n_terms >= 2')}
SELECT query_id, parent_asin, score, rank FROM best""")
def bm25_strict_topk(spark, sf_dir):
    best = R.bm25_strict_topk(N.part_index(spark, sf_dir), N.opening_queries(spark, sf_dir))
    return best


@query("category_route", f"""WITH {S.PRODUCTS}, {S.OPENINGS}
SELECT query_id, parent_asin FROM queries JOIN products ON lower(category) = category_key""")
def category_route(spark, sf_dir):
    return R.category_route(N.opening_queries(spark, sf_dir), N.part_products(spark, sf_dir))


LEXICAL_1000 = f"""{S.query_term_ctes('SELECT query_id, query_text FROM queries', 40)}, {S.score_ctes()}, {S.topk_cte('lexical', 1000)}"""
PART_SEARCH = f"{S.PRODUCTS}, {S.index_ctes(S.PART_FIELDS)}, {S.OPENINGS}, {LEXICAL_1000}"
CANDIDATES = PART_SEARCH + """,
cand AS (
  SELECT query_id, parent_asin, max(r) AS lexical_rank, bool_or(c) AS from_category FROM (
    SELECT query_id, parent_asin, rank AS r, false AS c FROM lexical
    UNION ALL SELECT query_id, parent_asin, NULL, true FROM queries JOIN products ON lower(category) = category_key)
  GROUP BY ALL)"""


@query("candidate_union", f"WITH {CANDIDATES} SELECT query_id, parent_asin, lexical_rank, from_category FROM cand")
def candidate_union(spark, sf_dir):
    inside, outside = N.opening_candidates(spark, sf_dir)
    return inside.unionByName(outside).drop("lexical_count")


@query("unseen_filter", f"""WITH {PART_SEARCH},
kept AS (SELECT l.* FROM lexical l WHERE l.rank <= 50 AND NOT EXISTS (
  SELECT 1 FROM opened o WHERE o.target = l.parent_asin AND o.intent || '|' || o.category || '|' || coalesce(o.constraint_text, '') = l.query_id))
SELECT query_id, parent_asin, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM kept""")
def unseen_filter(spark, sf_dir):
    from lodestone.operators.scoring import unseen

    ranked = R.bm25_topk(N.part_index(spark, sf_dir), N.opening_queries(spark, sf_dir), 50)
    shown = N.session_openings(spark, sf_dir).select("query_id", F.col("target").alias("parent_asin")).distinct()
    return unseen(ranked, shown)


FUSED = f"""{S.PRODUCTS}, {S.index_ctes(S.PART_FIELDS)}, {S.OPENINGS},
{S.query_term_ctes('SELECT query_id, query_text FROM queries', 50)}, {S.score_ctes()}, {S.topk_cte('broad', 120)},
{S.query_term_ctes('SELECT query_id, query_text FROM queries', 16, 'st')}, {S.score_ctes('strict_scores', 'st')},
{S.topk_cte('strict', 80, 'strict_scores', 'matched = n_terms AND n_terms >= 2')},
fused AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, broad_rank NULLS LAST, parent_asin) AS fused_rank FROM (
    SELECT coalesce(b.query_id, s.query_id) AS query_id, coalesce(b.parent_asin, s.parent_asin) AS parent_asin,
           b.rank AS broad_rank, s.rank AS strict_rank,
           round(coalesce(1.0::DOUBLE / (60 + b.rank), 0) + coalesce(1.8::DOUBLE / (20 + s.rank), 0), 12) AS fusion_score
    FROM broad b FULL JOIN strict s ON b.query_id = s.query_id AND b.parent_asin = s.parent_asin))"""


def _fused(spark, sf_dir):
    index, queries = N.part_index(spark, sf_dir), N.opening_queries(spark, sf_dir)
    broad = R.bm25_topk(index, queries, V.BROAD_LIMIT, limit=50)
    return U.reciprocal_rank_fusion(broad, R.bm25_strict_topk(index, queries))


@query("rank_fusion", f"""WITH {FUSED}
SELECT query_id, parent_asin, broad_rank, strict_rank, fusion_score, fused_rank FROM fused""")
def rank_fusion(spark, sf_dir):
    return _fused(spark, sf_dir)


COVERED = FUSED + f""",
covered AS (
  SELECT f.*, len(list_intersect({S.terms('q.query_text')}, p.search_terms)) AS coverage
  FROM fused f JOIN (SELECT DISTINCT query_id, query_text FROM queries) q USING (query_id) JOIN products p USING (parent_asin)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, fused_rank) AS coverage_rank FROM covered)"""


def _covered(spark, sf_dir):
    terms = N.opening_queries(spark, sf_dir).select("query_id", X.query_terms("query_text", 50).alias("terms"))
    return U.coverage_order(_fused(spark, sf_dir), terms, N.part_products(spark, sf_dir))


@query("coverage_cascade", f"WITH {COVERED} SELECT query_id, parent_asin, coverage, fused_rank, coverage_rank FROM ordered")
def coverage_cascade(spark, sf_dir):
    return _covered(spark, sf_dir).select("query_id", "parent_asin", "coverage", "fused_rank", "coverage_rank")


@query("coverage_histogram", f"WITH {COVERED} SELECT query_id, coverage, count(*)::BIGINT AS candidates FROM ordered GROUP BY ALL")
def coverage_histogram(spark, sf_dir):
    return U.coverage_histogram(_covered(spark, sf_dir))


# ---------------------------------------------------------------- vectors

CENTROIDS = """
flat AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label, i, round(avg(v), 9) AS m FROM flat GROUP BY ALL),
norms AS (SELECT label, sqrt(sum(m * m)) AS norm FROM means GROUP BY ALL),
units AS (SELECT CAST(label AS VARCHAR) AS query_id, i, m / norm AS u FROM means JOIN norms USING (label)),
sims AS (SELECT query_id, CAST(vec_id AS VARCHAR) AS parent_asin, round(sum(v * u), 9) AS similarity
         FROM flat JOIN units USING (i) GROUP BY ALL)"""


def centroid_queries(spark, sf_dir):
    """Mean vector of every label as a query vector."""
    flat = A.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    means = flat.groupBy("label", "i").agg(F.round(F.avg(F.col("v").cast("double")), 9).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
    return means.groupBy(F.col("label").cast("string").alias("query_id")).agg(ordered.alias("embedding"))


def vectors(spark, sf_dir):
    return A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("parent_asin"), "embedding")


def _dense(spark, sf_dir, k):
    return D.dense_topk(vectors(spark, sf_dir), centroid_queries(spark, sf_dir), k, 64)


@query("dense_topk", f"""WITH {CENTROIDS}
SELECT query_id, max(similarity) AS best, min(similarity) AS worst, count(*)::BIGINT AS found FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC) AS rank FROM sims) WHERE rank <= 20 GROUP BY query_id""")
def dense_topk(spark, sf_dir):
    best = _dense(spark, sf_dir, 20)
    return best.groupBy("query_id").agg(
        F.max("similarity").alias("best"), F.min("similarity").alias("worst"), F.count("*").alias("found"))


@query("dense_ranking", f"""WITH {CENTROIDS}
SELECT * FROM (SELECT query_id, parent_asin, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, parent_asin) AS rank FROM sims)
WHERE rank <= 50""")
def dense_ranking(spark, sf_dir):
    return _dense(spark, sf_dir, 50).select("query_id", "parent_asin", "rank")


@query("dense_calibration", f"""WITH {CENTROIDS},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, parent_asin) AS rank FROM sims) WHERE rank <= 50),
span AS (SELECT *, min(similarity) OVER (PARTITION BY query_id) AS lo, max(similarity) OVER (PARTITION BY query_id) AS hi FROM top)
SELECT query_id, parent_asin, round(similarity - lo, 9) AS margin, round((similarity - lo) / (hi - lo), 9) AS minmax FROM span""")
def dense_calibration(spark, sf_dir):
    best = _dense(spark, sf_dir, 50)
    margin = D.dense_scores(best, "margin").select("query_id", "parent_asin", F.col("dense_score").alias("margin"))
    minmax = D.dense_scores(best, "minmax").select("query_id", "parent_asin", F.col("dense_score").alias("minmax"))
    return margin.join(minmax, ["query_id", "parent_asin"])


@query("vector_checks", """
WITH e AS (SELECT vec_id, len(embedding) AS d, list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) AS s FROM embeddings)
SELECT count(*)::BIGINT AS rows, (count(*) - count(DISTINCT vec_id))::BIGINT AS repeated_ids,
       count(*) FILTER (d <> 64)::BIGINT AS wrong_width, count(*) FILTER (NOT isfinite(s))::BIGINT AS not_finite,
       count(*) FILTER (abs(sqrt(s) - 1) > 0.001)::BIGINT AS not_unit FROM e""")
def vector_checks(spark, sf_dir):
    return D.invalid_vectors(vectors(spark, sf_dir), 64)


@query("id_set_audit", """
SELECT 'documents without vector' AS audit, count(*)::BIGINT AS ids FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT 'vectors without document', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""")
def id_set_audit(spark, sf_dir):
    from lodestone.operators.quality import id_set_audit as audit

    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    vecs = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return audit(docs, vecs, "documents without vector", "vectors without document")


@query("question_category", f"""WITH {S.PRODUCTS}, {S.OPENINGS}
SELECT DISTINCT query_id, category, 'clothing' AS question_group FROM queries""")
def question_category(spark, sf_dir):
    return C.question_category(N.opening_queries(spark, sf_dir), N.part_products(spark, sf_dir))
