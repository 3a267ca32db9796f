"""The scalar functions called from SQL text over whole tables."""

from __future__ import annotations

from lodestone.functions import sql_functions
from lodestone.plans.registry import ORACLES, query
from lodestone.sources import adapters as A


def _labels(select: str, tables: dict):
    """A statement over named frames, planned with the SQL functions in place."""
    frame = next(iter(tables.values()))
    sql_functions.register(frame.sparkSession)
    return frame.sparkSession.sql(select, **tables)


@query("sql_product_labels", f"SELECT * FROM ({ORACLES['price_parse']}) JOIN ({ORACLES['category_labels']}) USING (parent_asin)")
def sql_product_labels(spark, sf_dir):
    return _labels("""
        SELECT parent_asin, price_number(price) AS number, price_is_lower_bound(price) AS is_lower_bound, first_number(price) AS first_number,
               price_kind(price) AS kind, price_band(price_number(price)) AS band, budget_bucket(first_number(price)) AS bucket,
               coarse_category(categories) AS coarse_category, array_join(specific_categories(categories), '/') AS specific,
               category_group(categories) AS category_group, fine_category_group(categories) AS fine_group,
               head_noun_group(coarse_category(categories)) AS head_group
        FROM {catalog}""", {"catalog": A.part_catalog(spark, sf_dir)})


@query("sql_document_departments", ORACLES["department_normalize"])
def sql_document_departments(spark, sf_dir):
    return _labels(r"""
        SELECT doc_id, normalized_department(label) AS department, explicit_department(label) AS explicit_department
        FROM (SELECT doc_id, source || ' ' || element_at(split(text, '\n'), 1) AS label FROM {documents})""", {"documents": A.table(spark, sf_dir, "documents")})


@query("sql_constraint_kinds", ORACLES["classify_constraint"])
def sql_constraint_kinds(spark, sf_dir):
    return _labels(r"""
        SELECT doc_id, constraint_kind(line) AS kind, count(*) AS lines
        FROM (SELECT doc_id, explode(split(text, '\n')) AS line FROM {documents}) GROUP BY ALL""", {"documents": A.table(spark, sf_dir, "documents")})
