"""Slots of products that share their texts."""

from pyspark.sql import functions as F

from lodestone.operators import slots as SL


def _catalog(spark, copies: int):
    return spark.range(copies).select(
        F.col("id").cast("string").alias("parent_asin"), F.lit("Red leather boots").alias("title"), F.array(F.lit("waterproof leather")).alias("features"),
        F.array(F.lit("Parts"), F.lit("Widgets")).alias("categories"), F.create_map(F.lit("Color"), F.lit("Blue")).alias("details"), F.lit("Acme").alias("store"))


def test_every_different_text_is_read_once(spark):
    texts = SL.source_texts(_catalog(spark, 40))
    named = ["source", "key", "text"]
    assert texts.select(*named, "raw").distinct().count() == 6
    said = SL.text_slots(texts.select(*named, "raw").distinct())
    assert said.count() == said.select(*named, "slot", "value").distinct().count() < 40


def test_copies_have_the_slots_of_one_product(spark):
    one = {tuple(r)[1:] for r in SL.product_slots(_catalog(spark, 1)).collect()}
    rows = SL.product_slots(_catalog(spark, 40)).collect()
    assert len(rows) == 40 * len(one) and {tuple(r)[1:] for r in rows} == one
    held = {(slot, value): (source, confidence, raw) for slot, value, source, confidence, raw in one}
    assert held["color", "blue"] == ("details.color", 0.98, "Color: Blue")
    assert held["material", "leather"] == ("features", 0.9, "waterproof leather")
    assert held["category", "widgets"] == ("categories", 1.0, "Widgets")
    assert held["brand", "acme"] == ("store", 1.0, "Acme")


def test_phrases_are_whole_words_in_a_row(spark):
    texts = ["", "red", "hook and loop", "the hook and loop zip", "hooks and loop", "plus size slim fit", "fleece lined fleece", "reddish tshirts", "size plus"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.array_sort(SL._slot_keys("t")).alias("k"), F.array_sort(SL._consumed("t")).alias("w")).collect()
    every = [(p, f"{s}={v}") for s, words in SL.SV.SLOTS.items() for p, v in words.items()]
    phrases = {p for p, _ in every} | set(SL.SV.CATEGORIES)
    for r in rows:
        assert r.k == sorted({v for p, v in every if f" {p} " in f" {r.t} "})
        assert r.w == sorted({w for p in phrases if f" {p} " in f" {r.t} " for w in p.split(" ")})


def test_canonical_forms_are_made_once(spark):
    states = spark.createDataFrame(
        [("q", "Red Boots", ["hook", "and", "loop", "slip-on", "red"], ["black"])],
        "query_id string, category_text string, active_terms array<string>, excluded_terms array<string>")
    view = SL.constraint_view(states)
    assert view._jdf.queryExecution().executedPlan().toString().count("regexp_replace(") < 50
    row = view.first()
    assert [(c.slot, c.value, c.source) for c in row.positive] == [
        ("closure", "hook and loop", "active_terms"), ("closure", "slip on", "active_terms"), ("color", "red", "active_terms")]
    assert [(c.slot, c.value) for c in row.negative] == [("color", "black")] and row.category_terms == ["boot"] and row.exact_terms == []
