"""Attribute slots, evidence, negatives and slot-based reranking over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import slot_vocab as SV
from lodestone.functions import text as X
from lodestone.functions import vocab as V
from lodestone.functions.canonical import canonical
from lodestone.operators import facets as FA
from lodestone.operators import fusion as U
from lodestone.operators import rerank as RR
from lodestone.operators import slots as SL
from lodestone.plans import inputs as N
from lodestone.plans import sql as S
from lodestone.plans.registry import built_once, query
from lodestone.plans.scoring_queries import STATS
from lodestone.plans.search_queries import COVERED, FUSED, _covered, _fused
from lodestone.session import write_table
from lodestone.sources import adapters as A


def canon_sql(e: str) -> str:
    text = f"replace(replace(lower({e}), 'ß', 'ss'), '’', '''')"
    text = f"regexp_replace(replace({text}, '&', ' and '), '\\b(men|women|boy|girl)''s\\b', '\\1', 'g')"
    text = f"trim(regexp_replace(regexp_replace({text}, '[^a-z0-9.$% ]+', ' ', 'g'), ' +', ' ', 'g'))"
    for old, new in sorted(SV.ALIASES.items(), key=lambda kv: (-len(kv[0]), kv[0])):
        text = f"regexp_replace({text}, '\\b{old}\\b', '{new}', 'g')"
    return text


@query("canonical_values", f"SELECT doc_id, {canon_sql('text')} AS canonical FROM documents")
def canonical_values(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", canonical("text").alias("canonical"))


VOCAB = "vocab(slot, phrase, value) AS (VALUES " + ", ".join(
    f"('{s}', '{p}', '{v}')" for s, words in [*SV.SLOTS.items(), ("category", SV.CATEGORIES)] for p, v in words.items()) + ")"


@query("vocabulary_phrases", f"""WITH {VOCAB},
d AS (SELECT doc_id, ' ' || {canon_sql('text')} || ' ' AS t FROM documents)
SELECT doc_id, slot, string_agg(DISTINCT value, ',' ORDER BY value) AS found FROM d JOIN vocab ON contains(t, ' ' || phrase || ' ') GROUP BY ALL""")
def vocabulary_phrases(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select("doc_id", canonical("text").alias("normalized"))
    hits = SL.vocabulary_hits(docs, ["doc_id"])
    return hits.groupBy("doc_id", "slot").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("found"))


_DETAIL_SLOT = "CASE " + " ".join(
    f"WHEN regexp_matches(key, '{'|'.join(ms)}') THEN '{s}'" for s, ms in SV.DETAIL_SLOTS) + " END"


@query("detail_slot_mapping", f"""WITH {S.PART_CATALOG}, k AS (SELECT parent_asin, lower(d.k) AS key FROM (SELECT parent_asin, unnest(details) AS d FROM catalog))
SELECT key, {_DETAIL_SLOT} AS slot, count(*)::BIGINT AS products FROM k GROUP BY ALL""")
def detail_slot_mapping(spark, sf_dir):
    keys = A.part_catalog(spark, sf_dir).select(F.explode(F.map_keys("details")).alias("raw")).select(canonical("raw").alias("key"))
    return keys.groupBy("key", SL.detail_slot("key").alias("slot")).agg(F.count("*").alias("products"))


_GENERIC = S.quoted(SV.GENERIC_LABELS)
_HAS = "contains(' ' || norm || ' ', ' ' || phrase || ' ')"
SLOTS_BODY = f"""{VOCAB},
raws AS (SELECT parent_asin, unnest(list_concat(
    list_concat(list_transform(categories, lambda c: {{'s': 'categories', 'k': NULL::VARCHAR, 't': c, 'raw': c}}),
                [{{'s': 'title', 'k': NULL::VARCHAR, 't': title, 'raw': title}}, {{'s': 'store', 'k': NULL::VARCHAR, 't': store, 'raw': store}}]),
    list_concat(list_transform(features, lambda f: {{'s': 'features', 'k': NULL::VARCHAR, 't': f, 'raw': f}}),
                list_transform(details, lambda d: {{'s': 'details', 'k': d.k, 't': d.v, 'raw': d.k || ': ' || d.v}})))) AS x FROM catalog),
texts AS (SELECT parent_asin, x.s AS source, lower(x.k) AS key, x.raw AS raw, {canon_sql('x.t')} AS norm FROM raws),
keyed AS (SELECT *, CASE WHEN source = 'details' THEN {_DETAIL_SLOT} END AS dslot FROM texts),
found AS (
  SELECT parent_asin, source, key, raw, slot, value FROM keyed JOIN vocab ON {_HAS}
  WHERE source <> 'store' AND CASE WHEN source = 'details' THEN slot = dslot
        WHEN slot = 'category' THEN source IN ('categories', 'title') AND norm NOT IN ({_GENERIC}) ELSE true END
  UNION ALL
  SELECT parent_asin, source, key, raw, 'category', norm FROM keyed k WHERE source = 'categories' AND norm NOT IN ({_GENERIC}) AND norm <> ''
    AND len(string_split(norm, ' ')) <= 4 AND NOT EXISTS (SELECT 1 FROM vocab WHERE slot IN ('category', 'audience') AND {_HAS})
  UNION ALL SELECT parent_asin, source, key, raw, 'brand', norm FROM keyed WHERE source = 'store' OR dslot = 'brand'),
graded AS (SELECT *, CASE WHEN source = 'details' THEN 'details.' || key ELSE source END AS src,
             CASE source WHEN 'categories' THEN 1.0::DOUBLE WHEN 'details' THEN 0.98::DOUBLE WHEN 'store' THEN 1.0::DOUBLE WHEN 'features' THEN 0.9::DOUBLE ELSE 0.82::DOUBLE END AS confidence
           FROM found WHERE value NOT IN ({S.quoted(SV.NOISE_VALUES)}) AND NOT regexp_matches(value, '^[0-9]+$')),
slots AS (SELECT parent_asin, slot, value, src AS source, confidence, raw FROM (
  SELECT *, row_number() OVER (PARTITION BY parent_asin, slot, value ORDER BY confidence DESC, contains(src, '.') DESC, src DESC, raw DESC) AS k FROM graded) WHERE k = 1)"""
SLOTS_CTE = S.PART_CATALOG + ", " + SLOTS_BODY


def part_slots(spark, sf_dir):
    return built_once(spark, sf_dir, "part_slots", build=lambda: write_table(SL.product_slots(N.part_catalog(spark, sf_dir)), "slots"))


@query("product_slots", f"WITH {SLOTS_CTE} SELECT * FROM slots")
def product_slots(spark, sf_dir):
    return SL.product_slots(N.part_catalog(spark, sf_dir))


_BITS = "CASE " + " ".join(
    f"WHEN slot = '{s}' AND value = '{v}' THEN {b}" for s, bits in SV.MASK_BITS.items() for v, b in bits.items()) + " ELSE 0 END"
MASKS_CTE = SLOTS_CTE + f""",
masks AS (SELECT parent_asin, {', '.join(
    f"coalesce(bit_or(CASE WHEN slot = '{s}' AND confidence >= 0.9 THEN {_BITS} ELSE 0 END), 0)::BIGINT AS {s}_mask" for s in SV.MASK_SLOTS)}
  FROM slots GROUP BY parent_asin)"""


@query("evidence_masks", f"WITH {MASKS_CTE} SELECT * FROM masks")
def evidence_masks(spark, sf_dir):
    return SL.evidence_masks(part_slots(spark, sf_dir), N.part_products(spark, sf_dir))


@query("evidence_table_checks", f"WITH {MASKS_CTE} SELECT count(*)::BIGINT AS rows, 0::BIGINT AS repeated_ids, 0::BIGINT AS outside_registry FROM masks")
def evidence_table_checks(spark, sf_dir):
    return SL.evidence_table_violations(SL.evidence_masks(part_slots(spark, sf_dir)))


# Conversation states: the opening queries, with words that browsing customers rule out.
def opening_states(spark, sf_dir):
    excluded = F.when(F.col("intent") == "browsing", F.array(F.lit("red"), F.lower(F.substring_index("category", " ", 1)))).otherwise(
        F.array().cast("array<string>"))
    return N.opening_queries(spark, sf_dir).select(
        "query_id", F.col("category").alias("category_text"),
        F.flatten(F.transform("constraints", lambda c: X.terms(c, V.CONVERSATION_STOPWORDS))).alias("active_terms"),
        excluded.alias("excluded_terms"))


_ACTIVE = S.terms("constraint_text", V.CONVERSATION_STOPWORDS)
VIEW_CTE = f"""
states AS (SELECT query_id, category, CASE WHEN constraint_text IS NULL THEN [] ELSE {_ACTIVE} END AS active,
             CASE WHEN intent = 'browsing' THEN ['red', lower(split_part(category, ' ', 1))] ELSE [] END AS excluded FROM queries),
norms AS (SELECT query_id, active, excluded, {canon_sql('category')} AS cat, {canon_sql("array_to_string(active, ' ')")} AS act,
            {canon_sql("array_to_string(excluded, ' ')")} AS exc FROM states),
pos AS (SELECT DISTINCT query_id, slot, value FROM norms JOIN vocab ON slot <> 'category' AND
          (contains(' ' || cat || ' ', ' ' || phrase || ' ') OR contains(' ' || act || ' ', ' ' || phrase || ' '))),
neg AS (SELECT DISTINCT query_id, slot, value FROM norms JOIN vocab ON slot <> 'category' AND contains(' ' || exc || ' ', ' ' || phrase || ' ')),
vwords AS (SELECT DISTINCT query_id, src, unnest(string_split(phrase, ' ')) AS w FROM (
  SELECT query_id, 'cat' AS src, cat AS t FROM norms UNION ALL SELECT query_id, 'act', act FROM norms UNION ALL SELECT query_id, 'exc', exc FROM norms)
  JOIN vocab ON contains(' ' || t || ' ', ' ' || phrase || ' ')),
catknown AS (SELECT DISTINCT query_id, value AS term FROM norms JOIN vocab ON slot = 'category' AND contains(' ' || cat || ' ', ' ' || phrase || ' ')),
catloose AS (SELECT DISTINCT query_id, t AS term FROM (SELECT query_id, unnest(string_split(cat, ' ')) AS t FROM norms) n
  WHERE length(t) > 1 AND t NOT IN ({S.quoted(SV.NOISE_VALUES)}) AND query_id NOT IN (SELECT query_id FROM catknown)
    AND NOT EXISTS (SELECT 1 FROM vwords v WHERE v.query_id = n.query_id AND src = 'cat' AND w = t)),
catterms AS (SELECT * FROM catknown UNION ALL SELECT * FROM catloose),
exact AS (SELECT DISTINCT query_id, t AS term FROM (SELECT query_id, unnest(active) AS t FROM norms) n WHERE t NOT IN ({S.quoted(SV.NOISE_VALUES)})
  AND NOT regexp_matches(t, '^[0-9]+$') AND NOT EXISTS (SELECT 1 FROM vwords v WHERE v.query_id = n.query_id AND src = 'act' AND w = t)),
exex AS (SELECT DISTINCT query_id, t AS term FROM (SELECT query_id, unnest(excluded) AS t FROM norms) n WHERE t NOT IN ({S.quoted(SV.NOISE_VALUES)})
  AND NOT EXISTS (SELECT 1 FROM vwords v WHERE v.query_id = n.query_id AND src = 'exc' AND w = t)),
viewed AS (SELECT query_id,
  coalesce((SELECT string_agg(term, ',' ORDER BY term) FROM catterms c WHERE c.query_id = n.query_id), '') AS category_terms,
  coalesce((SELECT string_agg(slot || '=' || value, ',' ORDER BY slot || '=' || value) FROM pos p WHERE p.query_id = n.query_id), '') AS positive,
  coalesce((SELECT string_agg(slot || '=' || value, ',' ORDER BY slot || '=' || value) FROM neg p WHERE p.query_id = n.query_id), '') AS negative,
  coalesce((SELECT string_agg(term, ',' ORDER BY term) FROM exact e WHERE e.query_id = n.query_id), '') AS exact_terms,
  coalesce((SELECT string_agg(term, ',' ORDER BY term) FROM exex e WHERE e.query_id = n.query_id), '') AS excluded_exact_terms FROM norms n)"""


def _view(spark, sf_dir):
    return SL.constraint_view(opening_states(spark, sf_dir))


@query("constraint_view", f"WITH {S.OPENINGS}, {VOCAB}, {VIEW_CTE} SELECT * FROM viewed")
def constraint_view(spark, sf_dir):
    keys = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["slot"], x["value"])), ",")
    return _view(spark, sf_dir).select(
        "query_id", F.array_join("category_terms", ",").alias("category_terms"), keys("positive").alias("positive"),
        keys("negative").alias("negative"), F.array_join("exact_terms", ",").alias("exact_terms"),
        F.array_join("excluded_exact_terms", ",").alias("excluded_exact_terms"))


# ---------------------------------------------------------------- negatives

WITH_SLOTS = FUSED + "," + SLOTS_BODY
JUDGED = WITH_SLOTS + "," + VIEW_CTE + f""",
held AS (SELECT parent_asin, slot, list(DISTINCT value) AS vs FROM slots WHERE confidence >= 0.9 GROUP BY ALL),
negs AS (SELECT * FROM neg WHERE slot IN ({S.quoted(SV.MASK_SLOTS)})),
judged AS (
  SELECT query_id, parent_asin, fused_rank, CASE WHEN count(n.slot) = 0 THEN 'unknown' WHEN bool_or(list_contains(vs, n.value)) THEN 'explicit_violation'
         WHEN bool_or(n.slot IS NOT NULL AND vs IS NULL) THEN 'unknown' ELSE 'compatible' END AS state
  FROM fused LEFT JOIN negs n USING (query_id) LEFT JOIN held h USING (parent_asin, slot) GROUP BY ALL)"""


def _negatives(spark, sf_dir):
    rows = _view(spark, sf_dir).select("query_id", F.explode("negative").alias("n")).select("query_id", "n.slot", "n.value")
    return rows.filter(F.col("slot").isin(*SV.MASK_SLOTS))


def _judged(spark, sf_dir):
    return RR.classify_candidates(
        _fused(spark, sf_dir).select("query_id", "parent_asin", "fused_rank", "fusion_score"), _negatives(spark, sf_dir), part_slots(spark, sf_dir))


@query("negative_classification", f"WITH {JUDGED} SELECT query_id, parent_asin, state FROM judged")
def negative_classification(spark, sf_dir):
    return _judged(spark, sf_dir).select("query_id", "parent_asin", "state")


@query("negative_classification_masks", f"WITH {JUDGED} SELECT query_id, parent_asin, state FROM judged")
def negative_classification_masks(spark, sf_dir):
    fused = _fused(spark, sf_dir).select("query_id", "parent_asin", "fused_rank")
    masks = SL.evidence_masks(part_slots(spark, sf_dir))
    return RR.classify_masks(fused, _negatives(spark, sf_dir), masks).select("query_id", "parent_asin", "state")


PARTITIONED = JUDGED + """,
parted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank > 50,
    CASE WHEN fused_rank > 50 THEN 0 WHEN state = 'compatible' THEN 0 WHEN state = 'unknown' THEN 1 ELSE 2 END, fused_rank) AS partition_rank FROM judged)"""


@query("negative_partition", f"WITH {PARTITIONED} SELECT query_id, parent_asin, state, fused_rank, partition_rank FROM parted")
def negative_partition(spark, sf_dir):
    return U.negative_partition(_judged(spark, sf_dir), "fused_rank").select("query_id", "parent_asin", "state", "fused_rank", "partition_rank")


@query("negative_partition_fallback", f"""WITH {PARTITIONED}, c AS (
  SELECT query_id, count(*) FILTER (fused_rank <= 50 AND state = 'compatible')::BIGINT AS compatible, count(*) FILTER (fused_rank <= 50 AND state = 'unknown')::BIGINT AS unknown,
         count(*) FILTER (fused_rank <= 50 AND state = 'explicit_violation')::BIGINT AS explicit_violation, count(*)::BIGINT AS n FROM parted GROUP BY 1)
SELECT query_id, compatible, unknown, explicit_violation, greatest(0, least(10, n) - least(10, compatible + unknown))::BIGINT AS fallback FROM c""")
def negative_partition_fallback(spark, sf_dir):
    return U.violation_fallback(_judged(spark, sf_dir), "fused_rank")


# ---------------------------------------------------------------- slot-constraint score

SCORED_SLOTS = WITH_SLOTS + "," + VIEW_CTE + """,
pool AS (SELECT *, fusion_score / max(fusion_score) OVER (PARTITION BY query_id) AS rrf FROM fused WHERE fused_rank <= 50),
spoken AS (SELECT parent_asin, value AS t FROM slots UNION SELECT parent_asin, w FROM (SELECT parent_asin, unnest(string_split(value, ' ')) AS w FROM slots) WHERE length(w) > 1),
cwords AS (SELECT DISTINCT parent_asin, w FROM (SELECT parent_asin, unnest(string_split(value, ' ')) AS w FROM slots WHERE slot = 'category') WHERE length(w) > 1),
cm AS (SELECT p.query_id, p.parent_asin, count(w) / count(*)::DOUBLE AS m FROM pool p JOIN catterms c USING (query_id) LEFT JOIN cwords w ON w.parent_asin = p.parent_asin AND w.w = c.term GROUP BY ALL),
pm AS (SELECT p.query_id, p.parent_asin, sum(coalesce(confidence, 0)) / count(*)::DOUBLE AS m FROM pool p JOIN pos c USING (query_id)
       LEFT JOIN slots s ON s.parent_asin = p.parent_asin AND s.slot = c.slot AND s.value = c.value GROUP BY ALL),
nm AS (SELECT p.query_id, p.parent_asin, sum(coalesce(confidence, 0)) / count(*)::DOUBLE AS m FROM pool p JOIN neg c USING (query_id)
       LEFT JOIN slots s ON s.parent_asin = p.parent_asin AND s.slot = c.slot AND s.value = c.value GROUP BY ALL),
em AS (SELECT p.query_id, p.parent_asin, count(t) / count(*)::DOUBLE AS m FROM pool p JOIN exact e USING (query_id) LEFT JOIN spoken s ON s.parent_asin = p.parent_asin AND s.t = e.term GROUP BY ALL),
xm AS (SELECT p.query_id, p.parent_asin, CASE WHEN count(t) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m FROM pool p JOIN exex e USING (query_id) LEFT JOIN spoken s ON s.parent_asin = p.parent_asin AND s.t = e.term GROUP BY ALL),
slot_scored AS (
  SELECT p.query_id, p.parent_asin, p.fused_rank, rrf, coalesce(cm.m, 0) AS category_match, coalesce(pm.m, 0) AS positive_match, coalesce(em.m, 0) AS exact_match,
         greatest(coalesce(nm.m, 0), coalesce(xm.m, 0)) AS negative_match
  FROM pool p LEFT JOIN cm USING (query_id, parent_asin) LEFT JOIN pm USING (query_id, parent_asin) LEFT JOIN nm USING (query_id, parent_asin)
  LEFT JOIN em USING (query_id, parent_asin) LEFT JOIN xm USING (query_id, parent_asin))"""


def _slot_scored(spark, sf_dir):
    pool = _fused(spark, sf_dir).filter(F.col("fused_rank") <= RR.RERANK_POOL).select("query_id", "parent_asin", "fused_rank", "fusion_score")
    evidence = RR.product_evidence(part_slots(spark, sf_dir), N.part_products(spark, sf_dir))
    return RR.slot_constraint_scores(pool, _view(spark, sf_dir), evidence)


# Which slots of the request a product shows at all.
SIGNED_SLOTS = SCORED_SLOTS + """,
requested AS (SELECT query_id, slot FROM pos UNION SELECT query_id, slot FROM neg UNION SELECT query_id, 'category' FROM catterms),
shown AS (SELECT parent_asin, slot FROM slots UNION SELECT parent_asin, 'price' FROM products WHERE price IS NOT NULL),
signed AS (
  SELECT s.query_id, s.parent_asin, coalesce(string_agg(h.slot, ',' ORDER BY h.slot), '') AS signature
  FROM slot_scored s LEFT JOIN requested r USING (query_id) LEFT JOIN shown h ON h.parent_asin = s.parent_asin AND h.slot = r.slot GROUP BY ALL),
totaled AS (
  SELECT s.*, signature, price, round(0.45 * rrf + 0.15 * category_match + 0.25 * positive_match + 0.15 * exact_match - 0.10 * negative_match, 9) AS total
  FROM slot_scored s JOIN signed USING (query_id, parent_asin) JOIN products USING (parent_asin))"""


@query("slot_constraint_scores", f"""WITH {SIGNED_SLOTS}
SELECT query_id, parent_asin, round(rrf, 9) AS rrf, round(category_match, 9) AS category_match, round(positive_match, 9) AS positive_match,
  round(exact_match, 9) AS exact_match, round(negative_match, 9) AS negative_match, signature, total FROM totaled""")
def slot_constraint_scores(spark, sf_dir):
    return _slot_scored(spark, sf_dir).drop("fused_rank", "price")


@query("guarded_insertion", f"""WITH RECURSIVE {SIGNED_SLOTS},
page AS (SELECT query_id, fused_rank, {{'p': parent_asin, 'r': fused_rank, 's': signature, 't': total}} AS c FROM totaled WHERE fused_rank <= 10),
walk AS (
  SELECT query_id, fused_rank AS k, [c] AS done FROM page WHERE fused_rank = 1
  UNION ALL
  SELECT query_id, k, list_concat(list_concat(done[1:stay], [c]), done[stay + 1:]) FROM (
    SELECT w.query_id, n.fused_rank AS k, w.done, n.c,
           list_max(list_transform(w.done, lambda e, i: CASE WHEN e.s = n.c.s AND e.t < n.c.t THEN 0 ELSE i END)) AS stay
    FROM walk w JOIN page n ON n.query_id = w.query_id AND n.fused_rank = w.k + 1)),
ended AS (SELECT query_id, arg_max(done, k) AS done FROM walk GROUP BY 1),
placed AS (SELECT query_id, unnest(done) AS e, generate_subscripts(done, 1) AS rank FROM ended)
SELECT query_id, e.p AS parent_asin, e.r AS fused_rank, rank, e.t AS total FROM placed""")
def guarded_insertion(spark, sf_dir):
    return RR.guarded_insertion(_slot_scored(spark, sf_dir))


@query("structured_order", f"""WITH {SIGNED_SLOTS},
budget AS (SELECT DISTINCT query_id, ['max', 'min', 'around'][length(category) % 3 + 1] AS kind, budget_max AS amount FROM queries WHERE budget_max IS NOT NULL),
fitted AS (
  SELECT query_id, parent_asin, fused_rank, total, kind, bool_or(price IS NULL) OVER (PARTITION BY query_id) AS unpriced,
         CASE kind WHEN 'max' THEN CASE WHEN price <= amount THEN 1 ELSE 0 END WHEN 'min' THEN CASE WHEN price >= amount THEN 1 ELSE 0 END
              ELSE greatest(0, 1 - abs(price - amount) / greatest(amount, 1)) END AS fit
  FROM totaled LEFT JOIN budget USING (query_id)),
judged_budget AS (SELECT *, CASE WHEN kind IS NULL THEN total WHEN NOT unpriced THEN round(0.85::DOUBLE * total + 0.15::DOUBLE * fit, 12) END AS structured_score FROM fitted)
SELECT query_id, parent_asin, fused_rank, structured_score,
       row_number() OVER (PARTITION BY query_id ORDER BY structured_score DESC NULLS LAST, fused_rank) AS structured_rank FROM judged_budget""")
def structured_order(spark, sf_dir):
    """The budgets of the openings, told as ceilings, floors and centres by the length of the category."""
    queries = N.opening_queries(spark, sf_dir).filter("budget_max is not null")
    kinds = F.array(*[F.lit(k) for k in ("max", "min", "around")])
    budgets = queries.select("query_id", F.get(kinds, F.length("category") % 3).alias("kind"), F.col("budget_max").alias("amount"))
    return RR.structured_order(_slot_scored(spark, sf_dir), budgets)


# ---------------------------------------------------------------- feature score inputs


@query("subtype_priors", f"""WITH {S.PRODUCTS}, {STATS},
b AS (SELECT parent_asin, lower(category_path[3]) AS subtype, rating_number::DOUBLE AS n,
        round((rating_number * average_rating + median_n * mean_rating) / (rating_number + median_n), 9) AS bayes FROM products, cstats)
SELECT parent_asin, subtype, round(percent_rank() OVER (PARTITION BY subtype ORDER BY bayes), 9) AS bayesian_rating_percentile,
       round(percent_rank() OVER (PARTITION BY subtype ORDER BY n), 9) AS popularity_percentile FROM b""")
def subtype_priors(spark, sf_dir):
    rows = SL.subtype_priors(N.part_catalog(spark, sf_dir), N.part_stats(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 9) for c in ("bayesian_rating_percentile", "popularity_percentile")})


@query("query_subtypes", f"""WITH {S.PART_CATALOG}, {S.OPENINGS},
obs AS (SELECT parent_asin, lower(categories[3]) AS subtype FROM catalog),
inf AS (SELECT DISTINCT c.parent_asin, o.subtype FROM catalog c JOIN (SELECT DISTINCT subtype FROM obs) o ON contains(' ' || title || ' ', ' ' || o.subtype || ' ')),
st AS (SELECT subtype, count(*) AS df FROM (SELECT * FROM obs UNION SELECT * FROM inf) GROUP BY 1),
hit AS (SELECT DISTINCT query_id, subtype, df FROM queries JOIN st ON contains(' ' || lower(category) || ' ', ' ' || subtype || ' '))
SELECT query_id, subtype, row_number() OVER (PARTITION BY query_id ORDER BY len(string_split(subtype, ' ')) DESC, df, subtype) AS place FROM hit
QUALIFY place <= 4""")
def query_subtypes(spark, sf_dir):
    stats = SL.subtype_stats(SL.product_subtypes(N.part_catalog(spark, sf_dir)))
    return SL.resolve_query_subtypes(N.opening_queries(spark, sf_dir), stats)


@query("rank_priors", f"""WITH {FUSED}
SELECT query_id, parent_asin, round(coalesce(61.0::DOUBLE / (60 + broad_rank), 0), 9) AS broad_rank_prior,
  round(coalesce(21.0::DOUBLE / (20 + strict_rank), 0), 9) AS strict_rank_prior, round(61.0::DOUBLE / (60 + fused_rank), 9) AS rrf_rank_prior FROM fused""")
def rank_priors(spark, sf_dir):
    return _fused(spark, sf_dir).select(
        "query_id", "parent_asin", F.round(RR.rank_prior(F.col("broad_rank"), 60), 9).alias("broad_rank_prior"),
        F.round(RR.rank_prior(F.col("strict_rank"), 20), 9).alias("strict_rank_prior"),
        F.round(RR.rank_prior(F.col("fused_rank"), 60), 9).alias("rrf_rank_prior"))


FIELD_SETS = f"""
fsets AS (SELECT parent_asin, {S.terms("title || ' ' || array_to_string(categories, ' ')", V.CONVERSATION_STOPWORDS)} AS a,
            {S.terms("array_to_string(features, ' ') || ' ' || " + S.DETAILS_TEXT, V.CONVERSATION_STOPWORDS)} AS b,
            {S.terms("array_to_string(description, ' ') || ' ' || store", V.CONVERSATION_STOPWORDS)} AS c FROM catalog),
qw AS (SELECT DISTINCT query_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS w FROM (
  SELECT query_id, unnest({S.terms('query_text', V.CONVERSATION_STOPWORDS)}) AS term FROM (SELECT DISTINCT query_id, query_text FROM queries)) JOIN stats USING (term))"""


def feature_page(spark, sf_dir):
    return _covered(spark, sf_dir).filter(F.col("coverage_rank") <= V.TOP_K)


def _conversation_terms(spark, sf_dir):
    return N.opening_queries(spark, sf_dir).select("query_id", X.query_terms("query_text", 50, V.CONVERSATION_STOPWORDS).alias("terms"))


def _feature_idf(spark, sf_dir):
    index = N.part_index(spark, sf_dir)
    n, df = F.col("doc_count"), F.col("df")
    return index.term_stats.crossJoin(F.broadcast(index.totals.select("doc_count"))).select(
        "term", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"))


@query("idf_coverage", f"""WITH {COVERED}, {FIELD_SETS},
page AS (SELECT query_id, parent_asin FROM ordered WHERE coverage_rank <= 10)
SELECT query_id, parent_asin,
  round(sum(CASE WHEN list_contains(a, term) OR list_contains(b, term) OR list_contains(c, term) THEN w ELSE 0 END) / sum(w), 9) AS idf_any_field_coverage,
  round(sum(CASE WHEN list_contains(a, term) THEN w ELSE 0 END) / sum(w), 9) AS title_category_coverage,
  round(sum(CASE WHEN list_contains(b, term) THEN w ELSE 0 END) / sum(w), 9) AS features_details_coverage,
  round(sum(CASE WHEN list_contains(c, term) THEN w ELSE 0 END) / sum(w), 9) AS description_store_coverage
FROM page JOIN qw USING (query_id) JOIN fsets USING (parent_asin) GROUP BY ALL""")
def idf_coverage(spark, sf_dir):
    fields = RR.field_group_terms(N.part_catalog(spark, sf_dir))
    rows = RR.idf_coverage(feature_page(spark, sf_dir), _conversation_terms(spark, sf_dir), _feature_idf(spark, sf_dir), fields)
    return rows.select("query_id", "parent_asin", *[F.round(c, 9).alias(c) for c in (
        "idf_any_field_coverage", "title_category_coverage", "features_details_coverage", "description_store_coverage")])


def linear_features(spark, sf_dir):
    """All inputs of the linear feature score for the first coverage page of every opening query."""
    catalog, slots, queries = N.part_catalog(spark, sf_dir), part_slots(spark, sf_dir), N.opening_queries(spark, sf_dir)
    page = built_once(spark, sf_dir, "feature_page", build=lambda: write_table(feature_page(spark, sf_dir), "feature_page"))
    keys = ["query_id", "parent_asin"]
    fields = RR.field_group_terms(catalog)
    coverage = RR.idf_coverage(page, _conversation_terms(spark, sf_dir), _feature_idf(spark, sf_dir), fields)
    subtypes = SL.product_subtypes(catalog)
    consistency = RR.subtype_consistency(page, SL.resolve_query_subtypes(queries, SL.subtype_stats(subtypes)), subtypes)
    view = _view(spark, sf_dir)
    hard = queries.select("query_id", F.coalesce("budget_hard", F.lit(False)).alias("hard"))
    ledger = view.select("query_id", F.explode("positive").alias("p")).join(hard, "query_id").select(
        "query_id", "p.slot", "p.value", F.when(F.col("hard"), "hard").otherwise("soft").alias("hardness"), F.lit(1).alias("source_turn"), F.lit(1).alias("version"))
    now = queries.select("query_id", F.lit(1).alias("turn"), F.lit(1).alias("version"))
    support = RR.positive_evidence(page, ledger, now, slots)
    clause = queries.select("query_id", RR.clause_grams(F.flatten(F.transform("constraints", lambda c: X.terms(c, V.CONVERSATION_STOPWORDS)))).alias("grams"))
    clauses = page.select(*keys).join(clause, "query_id").join(fields, "parent_asin").select(
        *keys, RR.clause_coverage("grams").alias("latest_hard_clause_coverage"))
    priors = SL.subtype_priors(catalog, N.part_stats(spark, sf_dir)).drop("subtype")
    states = RR.classify_masks(page.select(*keys), _negatives(spark, sf_dir), SL.evidence_masks(slots))
    ranks = page.select(
        *keys, F.col("coverage_rank").alias("rank"), RR.rank_prior(F.col("broad_rank"), 60).alias("broad_rank_prior"),
        RR.rank_prior(F.col("strict_rank"), 20).alias("strict_rank_prior"), RR.rank_prior(F.col("fused_rank"), 60).alias("rrf_rank_prior"))
    rows = ranks
    for part in (coverage, consistency, support, clauses, states):
        rows = rows.join(part, keys)
    return rows.join(priors, "parent_asin", "left")


@query("linear_feature_scores")
def linear_feature_scores(spark, sf_dir):
    return RR.linear_scores(linear_features(spark, sf_dir))


@query("near_tie_rerank")
def near_tie_rerank(spark, sf_dir):
    return RR.near_tie_order(RR.linear_scores(linear_features(spark, sf_dir)))


@query("slot_question_values", f"""WITH {WITH_SLOTS},
pool AS (SELECT query_id, parent_asin FROM fused WHERE fused_rank <= 50),
n50 AS (SELECT query_id, count(*)::BIGINT AS candidates FROM pool GROUP BY 1),
best AS (SELECT parent_asin, slot, value FROM (SELECT *, row_number() OVER (PARTITION BY parent_asin, slot ORDER BY confidence DESC, value) AS k FROM slots) WHERE k = 1
  UNION ALL SELECT parent_asin, 'budget', CASE WHEN price < 25 THEN 'under 25' WHEN price < 50 THEN '25 to 49' WHEN price < 100 THEN '50 to 99' ELSE '100 or more' END
  FROM products WHERE price IS NOT NULL),
cnt AS (SELECT query_id, slot, value, count(*)::BIGINT AS n FROM pool JOIN best USING (parent_asin) GROUP BY ALL),
per AS (SELECT query_id, slot, sum(n)::BIGINT AS covered, count(*)::BIGINT AS d, (log2(sum(n)) - sum(n * log2(n)) / sum(n)) AS h FROM cnt GROUP BY ALL HAVING count(*) >= 2),
val AS (SELECT query_id, slot, covered, d AS distinct_values, h / log2(d) AS gain, covered / candidates::DOUBLE AS coverage,
  CASE slot {' '.join(f"WHEN '{s}' THEN {a}::DOUBLE" for s, a in FA.SLOT_ANSWERABILITY.items())} END * CASE WHEN slot IN ('brand', 'feature') AND d > 8 THEN 8.0::DOUBLE / d ELSE 1.0::DOUBLE END AS answerability
  FROM per JOIN n50 USING (query_id))
SELECT query_id, slot, covered, distinct_values, round(gain, 9) AS information_gain, round(coverage, 9) AS coverage, round(answerability, 9) AS answerability,
  0.05::DOUBLE AS turn_cost, round(gain * coverage * answerability - 0.05::DOUBLE, 9) AS score FROM val WHERE coverage >= 0.2 AND answerability IS NOT NULL""")
def slot_question_values(spark, sf_dir):
    pool = _fused(spark, sf_dir).filter(F.col("fused_rank") <= 50).select("query_id", "parent_asin")
    answers = FA.slot_answers(pool, part_slots(spark, sf_dir), N.part_products(spark, sf_dir))
    turns = N.opening_queries(spark, sf_dir).select("query_id", F.lit(1).alias("turn"))
    return FA.question_values(answers, turns).drop("position")
