"""Every SQL function equals its column function, on ordinary and odd values."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import sql_functions
from lodestone.functions import text as X
from lodestone.functions import vocab as V

TEXTS = [
    None, "", "  ", "Black LEATHER boots, for Women's winter!", "unisex-kids  running shoes", "unisex infant", "ladies' bag", "boys' hat", "Rings and charms",
    "from 12.50", "FROM 3", " 19.999 ", "1e400", "$7.125 or so", "-3", "—", "under $30", "budget of 5", "size wide fit", "-; trimmed ,. ", "x" * 200 + " y",
    "a b c", "one", "two words", "hiking sleeve", "navy", "grey wool", "don't please"]
LISTS = [
    None, [], [""], ["Clothing, Shoes & Jewelry"], ["Clothing, Shoes & Jewelry", "Women", "Shoes"], ["Root", "Boot Shop"], ["Root", "Jewelry"], ["Root", "Clothing", "Hats"],
    ["Root", "Jewelry Watch Accessories"], ["A, B", " C "], ["Root", "Toe rings"], ["Clothing"]]
NUMBERS = [None, 0.0, 4.0, 4.5, 5.0, 14.99, 15.0, 24.0, 25.0, 49.99, 50.0, 99.0, 100.0]
COLUMNS = {
    "product_terms": X.terms, "conversation_terms": lambda c: X.terms(c, V.CONVERSATION_STOPWORDS), "query_terms": X.query_terms, "product_normalized": X.normalized,
    "coarse_category": X.coarse_category, "specific_categories": X.specific_categories, "category_group": X.category_group,
    "fine_category_group": X.fine_category_group, "head_noun_group": X.head_noun_group, "price_is_lower_bound": X.price_is_lower_bound,
    "price_number": X.price_number, "price_kind": X.price_kind, "first_number": X.first_number, "price_band": X.price_band, "budget_bucket": X.budget_bucket,
    "normalized_department": X.normalize_department, "explicit_department": X.extract_department, "first_material": X.first_material, "first_color": X.first_color,
    "clean_constraint": X.clean_constraint, "constraint_kind": X.classify_constraint, "purchase_frequency": X.purchase_frequency, "rating_style": X.rating_style}
VALUES = {"STRING": (TEXTS, "string"), "ARRAY<STRING>": (LISTS, "array<string>"), "DOUBLE": (NUMBERS, "double")}


def test_every_function_has_a_column():
    assert list(COLUMNS) == [f[0] for f in sql_functions.FUNCTIONS]


@pytest.mark.parametrize("takes", list(VALUES))
def test_functions_equal_columns(spark, takes):
    sql_functions.register(spark)
    values, kind = VALUES[takes]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, value {kind}")
    names = [f[0] for f in sql_functions.FUNCTIONS if f[1] == takes]
    rows = frame.select("value", *[F.struct(F.expr(f"{n}(value)").alias("sql"), COLUMNS[n]("value").alias("column")).alias(n) for n in names]).collect()
    for row in rows:
        for n in names:
            assert row[n]["sql"] == row[n]["column"], (n, row["value"])
