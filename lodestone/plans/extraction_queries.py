"""Extracted attributes: parsing, validation, repair, naming, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import quality as Q
from lodestone.plans.registry import query
from lodestone.sources import adapters as A


def responses(spark, sf_dir):
    """Model responses about the parts: some with defects in text, shape or evidence, by the size of the part."""
    words = F.split("p_name", " ")
    entry = lambda value, evidence, name=None: F.struct(
        *([F.lit(name).alias("name")] if name else []), value.alias("value"), evidence.alias("evidence"))
    size = F.col("p_size").cast("string")
    none = F.array().cast("array<struct<value:string,evidence:string>>")
    body = F.to_json(F.struct(
        none.alias("material"), F.array(entry(words[0], F.col("p_name"))).alias("color"),
        F.array(entry(F.concat(F.lit("size "), size), F.concat(F.lit("of size "), size))).alias("size_fit"),
        F.when(F.col("p_size") % 4 == 0, F.array(entry(F.lit("premium"), F.lit("premium")))).otherwise(none).alias("style"),
        F.when(F.col("p_size") % 11 != 0, none).alias("use_case"),
        F.array(entry(words[1], F.lit("not in source"), "closure_type"), entry(words[1], F.col("p_name"), "closure"),
                entry(words[1], F.col("p_name"), "Quality"), entry(words[1], F.col("p_name"), "quality")).alias("specific_attributes")))
    raw = F.when(F.col("p_size") % 7 == 0, F.concat(body, F.lit("\nExplanation"))).when(
        F.col("p_size") % 17 == 0, F.lit("[]")).otherwise(body)
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("parent_asin"), "p_size", raw.alias("raw_response"))


def records(spark, sf_dir):
    """Two runs: the first fails for some sizes, the second repeats half of those."""
    usage = F.struct(F.col("p_size").cast("bigint").alias("prompt_tokens"), F.lit(1).cast("bigint").alias("completion_tokens"))
    base = responses(spark, sf_dir).withColumn("usage", usage)
    first = base.select("parent_asin", F.lit(1).alias("seq"), F.when(F.col("p_size") % 13 == 0, "error").otherwise("success").alias("status"), "raw_response", "usage")
    second = base.filter("p_size % 26 = 0").select("parent_asin", F.lit(2).alias("seq"), F.lit("success").alias("status"), "raw_response", "usage")
    return first.unionByName(second)


def _documents(spark, sf_dir):
    return Q.evidence_document(A.part_catalog(spark, sf_dir))


@query("response_parsing", """
SELECT CASE WHEN p_size % 7 = 0 THEN 'trailing_text' WHEN p_size % 17 = 0 THEN NULL ELSE 'none' END AS repair_kind,
       CASE WHEN p_size % 7 <> 0 AND p_size % 17 = 0 THEN 'not an object' END AS error, count(*)::BIGINT AS responses FROM part GROUP BY ALL""")
def response_parsing(spark, sf_dir):
    return Q.parsed_responses(responses(spark, sf_dir)).groupBy("repair_kind", "error").agg(F.count("*").alias("responses"))


SOLD = "sold AS (SELECT DISTINCT l_partkey FROM lineitem), p AS (SELECT *, split_part(p_name, ' ', 1) AS w0, split_part(p_name, ' ', 2) AS w1 FROM part)"
ENTRIES = SOLD + """,
e AS (SELECT CAST(p_partkey AS VARCHAR) AS parent_asin, p_size, p_partkey IN (SELECT l_partkey FROM sold) AS known, w1, unnest([
  {'f': 'color', 'i': 0, 'n': NULL, 'v': w0, 'e': p_name, 'r': NULL},
  {'f': 'size_fit', 'i': 0, 'n': NULL, 'v': 'size ' || p_size, 'e': 'of size ' || p_size, 'r': NULL},
  {'f': 'style', 'i': 0, 'n': NULL, 'v': 'premium', 'e': 'premium', 'r': 'evidence is not an exact substring of the supplied product data'},
  {'f': 'specific_attributes', 'i': 0, 'n': 'closure_type', 'v': w1, 'e': 'not in source', 'r': 'value is not an exact substring of evidence'},
  {'f': 'specific_attributes', 'i': 1, 'n': 'closure', 'v': w1, 'e': p_name, 'r': NULL},
  {'f': 'specific_attributes', 'i': 2, 'n': 'Quality', 'v': w1, 'e': p_name, 'r': 'name is not lowercase snake_case'},
  {'f': 'specific_attributes', 'i': 3, 'n': 'quality', 'v': w1, 'e': p_name, 'r': 'name is a disallowed subjective attribute'}]) AS x FROM p
  WHERE p_size % 7 = 0 OR p_size % 17 <> 0),
entries AS (SELECT parent_asin, x.f AS field, x.i AS index, x.n AS name, x.v AS value, x.e AS evidence,
  CASE WHEN NOT known AND x.r IS DISTINCT FROM 'value is not an exact substring of evidence' THEN 'evidence is not an exact substring of the supplied product data' ELSE x.r END AS reason
  FROM e WHERE x.f <> 'style' OR p_size % 4 = 0)"""


def _entries(spark, sf_dir):
    usable = Q.parsed_responses(responses(spark, sf_dir)).filter("json is not null")
    return Q.validate_extractions(usable, _documents(spark, sf_dir))


@query("extraction_validation", f"WITH {ENTRIES} SELECT parent_asin, field, index, name, value, evidence, reason FROM entries")
def extraction_validation(spark, sf_dir):
    return _entries(spark, sf_dir)


@query("extraction_schema_errors", """
SELECT CAST(p_partkey AS VARCHAR) AS parent_asin, 'use_case must be an array' AS error FROM part WHERE p_size % 11 = 0 AND (p_size % 7 = 0 OR p_size % 17 <> 0)""")
def extraction_schema_errors(spark, sf_dir):
    usable = Q.parsed_responses(responses(spark, sf_dir)).filter("json is not null")
    return Q.extraction_schema_errors(usable)


REPAIRED = ENTRIES + """,
fixed AS (
  SELECT parent_asin, field, 1 AS position, name, value, evidence, false AS repaired FROM entries WHERE reason IS NULL
  UNION ALL SELECT parent_asin, field, 2, name, value, value, true FROM entries WHERE reason = 'value is not an exact substring of evidence'
    AND parent_asin IN (SELECT CAST(l_partkey AS VARCHAR) FROM sold))"""


@query("evidence_repair", f"WITH {REPAIRED} SELECT * FROM fixed")
def evidence_repair(spark, sf_dir):
    return Q.repair_evidence(_entries(spark, sf_dir), _documents(spark, sf_dir))


@query("attribute_names", f"""WITH {REPAIRED}
SELECT parent_asin, field, position, CASE WHEN name = 'closure_type' THEN 'closure' ELSE name END AS name, value, evidence, repaired,
       coalesce(name = 'closure_type', false) AS aliased, coalesce(name = 'closure_type', false) AS dropped FROM fixed""")
def attribute_names(spark, sf_dir):
    return Q.normalize_names(Q.repair_evidence(_entries(spark, sf_dir), _documents(spark, sf_dir)))


@query("postprocess_totals", f"""WITH {REPAIRED}
SELECT count(DISTINCT parent_asin)::BIGINT AS products, count(*) FILTER (repaired)::BIGINT AS evidence_repairs,
       count(*) FILTER (name = 'closure_type')::BIGINT AS aliased_names, count(*) FILTER (name = 'closure_type')::BIGINT AS duplicates_removed FROM fixed""")
def postprocess_totals(spark, sf_dir):
    return Q.postprocess(_entries(spark, sf_dir), _documents(spark, sf_dir))[1]


def primary(spark, sf_dir):
    final, _ = Q.postprocess(_entries(spark, sf_dir), _documents(spark, sf_dir))
    return Q.primary_values(Q.nest_attributes(final))


@query("primary_values", f"""WITH {REPAIRED}
SELECT parent_asin, field, CASE WHEN field = 'specific_attributes' THEN name END AS name, value FROM fixed WHERE coalesce(name, '') <> 'closure_type'""")
def primary_values(spark, sf_dir):
    return primary(spark, sf_dir)


@query("passages", f"""WITH {REPAIRED}, k AS (SELECT DISTINCT parent_asin FROM fixed),
c AS (SELECT CAST(p_partkey AS VARCHAR) AS parent_asin, p.* FROM p WHERE p_partkey IN (SELECT l_partkey FROM sold))
SELECT parent_asin, 'title: ' || p_name || chr(10) || 'category: Parts > ' || upper(p_type[1]) || lower(p_type[2:]) || ' > ' || upper(w1[1]) || w1[2:] || chr(10)
  || 'brand: ' || p_brand || chr(10) || 'department: ' || p_type || chr(10) || 'color: ' || w0 || chr(10) || 'size_fit: size ' || p_size || chr(10)
  || 'specific attributes: closure: ' || w1 AS text FROM c JOIN k USING (parent_asin)""")
def passages(spark, sf_dir):
    final, _ = Q.postprocess(_entries(spark, sf_dir), _documents(spark, sf_dir))
    attributes = Q.nest_attributes(final)
    catalog = A.part_catalog(spark, sf_dir).join(attributes.select("parent_asin"), "parent_asin", "left_semi")
    known = attributes.join(A.part_catalog(spark, sf_dir).select("parent_asin"), "parent_asin", "left_semi")
    return Q.passages(catalog, known)


@query("evidence_documents", f"""WITH {SOLD}
SELECT CAST(p_partkey AS VARCHAR) AS parent_asin, p_name AS title, p_brand || ' | ' || lower(p_type) || ' grade ' || p_name AS features,
       'A ' || p_name || ' of size ' || p_size AS description, 4::BIGINT AS details FROM p WHERE p_partkey IN (SELECT l_partkey FROM sold)""")
def evidence_documents(spark, sf_dir):
    return _documents(spark, sf_dir).select(
        "parent_asin", "title", F.array_join("features", " | ").alias("features"), F.array_join("description", " | ").alias("description"),
        F.size("details").cast("bigint").alias("details"))


RUNS = """
runs AS (SELECT CAST(p_partkey AS VARCHAR) AS parent_asin, 1 AS seq, CASE WHEN p_size % 13 = 0 THEN 'error' ELSE 'success' END AS status, p_size FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 2, 'success', p_size FROM part WHERE p_size % 26 = 0)"""


@query("latest_records", f"WITH {RUNS} SELECT parent_asin, seq, status FROM runs QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY seq DESC) = 1")
def latest_records(spark, sf_dir):
    return Q.latest_records(records(spark, sf_dir)).select("parent_asin", "seq", "status")


@query("run_status", f"WITH {RUNS} SELECT parent_asin, bool_or(status = 'success') AS completed, arg_max(status, seq) AS latest_status FROM runs GROUP BY 1")
def run_status(spark, sf_dir):
    return Q.run_status(records(spark, sf_dir))


@query("unfinished_products", f"WITH {RUNS}, {SOLD} SELECT CAST(l_partkey AS VARCHAR) AS parent_asin FROM sold WHERE CAST(l_partkey AS VARCHAR) NOT IN (SELECT parent_asin FROM runs WHERE status = 'success')")
def unfinished_products(spark, sf_dir):
    return Q.unfinished(A.part_catalog(spark, sf_dir), records(spark, sf_dir)).select("parent_asin")


@query("usage_totals", f"WITH {RUNS} SELECT sum(p_size)::BIGINT AS prompt_tokens, count(*)::BIGINT AS completion_tokens, (sum(p_size) + count(*))::BIGINT AS total_tokens FROM runs")
def usage_totals(spark, sf_dir):
    return Q.usage_totals(records(spark, sf_dir))


@query("run_summary", f"""WITH {RUNS}, {SOLD}, s AS (SELECT parent_asin, bool_or(status = 'success') AS done FROM runs WHERE parent_asin IN (SELECT CAST(l_partkey AS VARCHAR) FROM sold) GROUP BY 1)
SELECT count(*)::BIGINT AS catalog_products, count(*) FILTER (done)::BIGINT AS successful_products, count(*) FILTER (NOT done)::BIGINT AS remaining_products,
       count(*) FILTER (NOT done)::BIGINT AS error_products FROM s""")
def run_summary(spark, sf_dir):
    return Q.run_summary(A.part_catalog(spark, sf_dir), records(spark, sf_dir))


@query("recovered_responses", f"""WITH {ENTRIES}
SELECT CAST(p_partkey AS VARCHAR) AS parent_asin, count(*) FILTER (reason IS NULL)::BIGINT AS accepted, count(reason)::BIGINT AS rejected
FROM part JOIN entries ON parent_asin = CAST(p_partkey AS VARCHAR) WHERE p_size % 13 = 0 AND p_size % 26 <> 0 GROUP BY 1""")
def recovered_responses(spark, sf_dir):
    entries, _ = Q.recovered_responses(records(spark, sf_dir), _documents(spark, sf_dir))
    return entries.groupBy("parent_asin").agg(
        F.sum(F.col("reason").isNull().cast("bigint")).alias("accepted"), F.count("reason").alias("rejected"))
