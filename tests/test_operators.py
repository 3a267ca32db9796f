from pyspark.sql import functions as F

from lodestone.functions import messages as M
from lodestone.functions import text as X
from lodestone.functions.canonical import canonical, repaired_json, source_slice
from lodestone.operators import evaluation as E
from lodestone.operators import facets as FA
from lodestone.operators import quality as Q
from lodestone.operators import ranker as RK
from lodestone.operators import rerank as RR
from lodestone.operators import sampling as G
from lodestone.operators import vectors as D
from lodestone.operators.profile import department_audit, nearest_rank_summary, path_counts, taxonomy_summary
from lodestone.sources import catalog as C


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def words(*values):
    return F.array(*[F.lit(v) for v in values])


def test_prices_and_groups(spark):
    row = one(
        spark, a=X.price_number(F.lit("19.99")), b=X.price_number(F.lit("from 12.99")), c=X.price_number(F.lit("—")),
        d=X.price_is_lower_bound(F.lit("from 12.99")), e=X.category_group(words("Root", "Women", "Shoes", "Athletic")),
        f=X.category_group(words("Root", "Jewelry", "Rings")), g=X.category_group(words("Root", "Accessories")),
        h=X.fine_category_group(words("Root", "Jewelry & Watch Accessories", "Shoe Care & Accessories", "Shoelaces")),
        i=X.fine_category_group(words("Root", "Women", "Watches", "Wrist Watches")), j=X.price_band(F.lit(30.0)))
    assert tuple(row) == (19.99, 12.99, None, True, "shoes", "jewelry", "clothing", "shoes", "other", "$25-$50")


def test_departments_and_canonical(spark):
    row = one(
        spark, a=X.normalize_department(F.lit("Unisex-Child kids")), b=X.normalize_department(F.lit("Men's")),
        c=X.extract_department(F.lit("red shoes")), d=canonical(F.lit("Men’s T-Shirt & Ｇrey")), e=X.normalize_department(F.lit("Pets")))
    assert row.a == "unisex child" and row.c is None and row.d == "men tshirt and gray" and row.e == "pets"
    assert row.b == "mens"


def test_openings(spark):
    rows = spark.createDataFrame([
        ("I'm looking for Women Shoes, but I'm still exploring.",), ("I'm looking for Women Shoes. A key requirement is: leather.",),
        ("I'm looking for Women Shoes. Buckle closure",), ("socks",)], "m string").select(M.parse_opening("m").alias("p")).select("p.*").collect()
    assert [(r.intent, r.category, r.constraint, r.hard) for r in rows] == [
        ("browsing", "Women Shoes", None, False), ("buying", "Women Shoes", "leather", True),
        ("buying", "Women Shoes", "Buckle closure", False), ("buying", "socks", None, False)]


def test_taxonomy(spark):
    paths = path_counts(spark.createDataFrame([
        (["Root", "Women", "Watches", "Wrist Watches"],), (["Root", "Men", "Watches", "Wrist Watches"],),
        (["Root", "Promotion", "Wrist Watches"],), (["Root", "Women", "Shoes"],), ([],)], "categories array<string>"))
    s = taxonomy_summary(paths).first()
    assert (s.products, s.products_without_categories, s.leaf_labels, s.leaf_nodes, s.penultimate_labels, s.penultimate_nodes) == (5, 1, 2, 4, 3, 4)
    a = department_audit(paths).first()
    assert (a.with_second_level, a.department_products, a.department_fraction, a.always_department, a.other_labels) == (4, 3, 0.75, False, 1)


def test_percentiles_against_brute_force(spark):
    values = [float(v) for v in [1] * 40 + list(range(60))]
    got = nearest_rank_summary(spark.createDataFrame([("m", v) for v in values], "measure string, value double")).first()
    ordered = sorted(values)
    for name, f in {"p10": 0.1, "p50": 0.5, "p75": 0.75, "p99": 0.99}.items():
        assert got[name] == ordered[round(f * (len(ordered) - 1))]


def test_vectors(spark):
    vectors = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [0.0, 1.0]), ("C", [-1.0, 0.0])], "parent_asin string, embedding array<float>")
    query = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, embedding array<float>")
    found = D.dense_topk(vectors, query, 2, 2).orderBy("rank").collect()
    assert [(r.parent_asin, r.similarity) for r in found] == [("A", 1.0), ("B", 0.0)]
    sims = spark.createDataFrame([("q", "A", 0.8), ("q", "B", 0.7), ("q", "C", 0.6)], "query_id string, parent_asin string, similarity double")
    assert [r.dense_score for r in D.dense_scores(sims, "minmax").orderBy("parent_asin").collect()] == [1.0, 0.5, 0.0]
    assert [round(r.dense_score, 6) for r in D.dense_scores(sims, "margin").orderBy("parent_asin").collect()] == [0.2, 0.1, 0.0]


def test_vector_blocks_equal_broadcast(spark, monkeypatch):
    rows = [(f"v{i}", [float(i % 5) + 1, float(i % 3), 1.0]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "parent_asin string, embedding array<float>")
    queries = spark.createDataFrame([(f"q{i}", [1.0, float(i), 0.5]) for i in range(6)], "query_id string, embedding array<float>")
    plain = sorted(map(tuple, D.dense_topk(vectors, queries, 4, 3).collect()))
    monkeypatch.setattr(D, "QUERY_BLOCK", 2)
    monkeypatch.setattr(D, "VECTOR_BLOCK", 7)
    assert sorted(map(tuple, D.dense_topk(vectors, queries, 4, 3).collect())) == plain


def test_recurring_utility(spark):
    values = spark.createDataFrame(
        [("q", "color", v, 10) for v in ("red", "red", "blue", "blue", "green")], "query_id string, attribute string, value string, candidates bigint")
    row = FA.recurring_utility(values, ["query_id", "attribute"]).first()
    assert (row.answerability, row.discrimination, row.recurring) == (0.4, 0.4, 2)


def test_response_repair():
    assert repaired_json('{"size": "6\\\' wide"}') == ('{"size": "6\\\\\' wide"}', "escapes")
    assert repaired_json('{"intent": "buying"}\nExplanation') == ('{"intent": "buying"}', "trailing_text")
    assert repaired_json('{"value": "Leather", " "evidence": "Textile/Leather sole"}')[1] == "stray_quote"
    assert repaired_json("[]") == (None, "not an object")
    assert repaired_json("nonsense") == (None, "invalid json")


def test_source_slices():
    assert source_slice("memory foam", ["Includes a Memory   Foam footbed"]) == "Memory   Foam"
    assert source_slice("waterproof", ["Rain boot"]) is None
    assert source_slice("cos", ["Cosplay wig"]) is None
    assert source_slice("M", ["Size M shirt"]) == "M"


def test_extraction_rules(spark):
    documents = spark.createDataFrame(
        [("A", "Blue trail shoe", [], ["Memory foam footbed", "Reinforced rubber toe"], [], {"Closure": "Zipper"})],
        "parent_asin string, title string, categories array<string>, features array<string>, description array<string>, details map<string,string>")
    body = ('{"material": [{"value": "rubber", "evidence": "Reinforced rubber toe"}], "color": [{"value": "Blue", "evidence": "Blue trail shoe"}, '
            '{"value": "Red", "evidence": "Blue trail shoe"}], "size_fit": [], "style": [], "use_case": [], "specific_attributes": '
            '[{"name": "cushioning", "value": "Memory foam", "evidence": "Memory foam footbed"}, {"name": "closure_type", "value": "ZIPPER", "evidence": "none"}]}')
    responses = spark.createDataFrame([("A", body)], "parent_asin string, json string")
    entries = Q.validate_extractions(responses, documents)
    kept = {(r.field, r.value) for r in entries.filter("reason is null").collect()}
    assert kept == {("material", "rubber"), ("color", "Blue"), ("specific_attributes", "Memory foam")}
    assert Q.extraction_schema_errors(responses).count() == 0
    final, totals = Q.postprocess(entries, documents)
    added = [(r.name, r.evidence) for r in final.filter("repaired").collect()]
    assert added == [("closure", "Zipper")] and totals.first().evidence_repairs == 1
    bad = spark.createDataFrame([("B", '{"material": "cotton", "unknown": []}')], "parent_asin string, json string")
    errors = {r.error for r in Q.extraction_schema_errors(bad).collect()}
    assert {"material must be an array", "color must be an array", "unexpected root fields: unknown"} <= errors


def test_metrics(spark):
    outcomes = spark.createDataFrame(
        [("a", "buying", True, 2, 2, 0.5), ("b", "buying", False, None, None, 0.0)],
        "session_id string, scenario_type string, hit boolean, first_hit_turn int, best_rank int, reciprocal_rank double")
    row = E.metric_summary(outcomes).first()
    assert (row.sample_count, row.hit_rate_at_10, row.mrr, row.mttc) == (2, 0.5, 0.25, 6.5)
    third = outcomes.withColumn("first_hit_turn", F.when(F.col("hit"), 3))
    assert E.session_objective(third).first().objective == round(0.81 / 2, 9)


def test_recommendation_list(spark):
    log = spark.createDataFrame([("s", 1, ["A", "bad", "A", "B", "C"])], "session_id string, turn int, recommendations array<string>")
    catalog = spark.createDataFrame([("A",), ("B",), ("C",)], "parent_asin string")
    assert [r.parent_asin for r in E.normalize_recommendations(log, catalog).orderBy("rank").collect()] == ["A", "B", "C"]


def test_quotas():
    assert G.scenario_quotas(20) == [("buying", 8), ("browsing", 8), ("intent_override", 3), ("boundary", 1)]


def brute_insertion(page):
    done = []
    for c in page:
        at = len(done)
        while at and done[at - 1][1] == c[1] and done[at - 1][2] < c[2]:
            at -= 1
        done.insert(at, c)
    return [c[0] for c in done]


def test_guarded_insertion_against_brute_force(spark):
    page = [("a", "x", 0.1), ("b", "x", 0.3), ("c", "y", 0.9), ("d", "y", 0.95), ("e", "x", 0.99), ("f", "x", 1.0)]
    rows = [("q", p, i + 1, s, t) for i, (p, s, t) in enumerate(page)]
    df = spark.createDataFrame(rows, "query_id string, parent_asin string, fused_rank int, signature string, total double")
    got = [r.parent_asin for r in RR.guarded_insertion(df).orderBy("rank").collect()]
    assert got == brute_insertion(page)


def test_near_ties(spark):
    rows = [("q", "a", 1, 0.5000, 0.5000, 0), ("q", "b", 2, 0.4990, 0.5005, 0), ("q", "c", 3, 0.4975, 0.5100, 0), ("q", "d", 4, 0.9, 0.9, 1)]
    df = spark.createDataFrame(rows, "query_id string, parent_asin string, rank int, relevance double, total double, bucket int")
    got = [r.parent_asin for r in RR.near_tie_order(df).orderBy("new_rank").collect()]
    # c is more than the limit below a, so its better total cannot lift it; d is in a later bucket.
    assert got == ["b", "a", "c", "d"]


def test_tree_scores(spark):
    tree = {"left": [1, -1, -1], "right": [2, -1, -1], "feature": [0, 0, 0], "value": [0.5, -1.0, 2.0], "default_left": [1, 0, 0]}
    rows = spark.createDataFrame([("a", 0.4), ("b", 0.6), ("c", None)], "id string, x double")
    got = {r.id: r.ranker_score for r in RK.score_trees(rows, [tree, tree], 0.25, ("x",)).collect()}
    assert got == {"a": -1.75, "b": 4.25, "c": -1.75}


def test_products(catalog):
    rows = {r.parent_asin: r for r in C.products(catalog).collect()}
    assert rows["P0"].material == "leather" and rows["P3"].color == "red" and rows["P5"].department == "womens"
    # The umbrella label splits at its comma, so only its second half is no umbrella label by itself.
    assert rows["P0"].coarse_category == "Women Shoes"
    assert C.catalog_id_violations(catalog.unionByName(catalog.limit(1))).count() == 1


def test_index_text_is_spread_by_its_size(spark, monkeypatch):
    from lodestone.operators import search_index as I
    from lodestone.sources.catalog import CATALOG_SCHEMA

    rows = [(f"P{i}", "shoe wool", ["red"], ["soft " * 20], "1", ["Top"], {"k": "w"}, 4.0, 3, "Store") for i in range(200)]
    catalog = spark.createDataFrame(rows, CATALOG_SCHEMA)
    monkeypatch.setattr(I, "TASK_CHARS", 1000, raising=False)
    postings = I.build_postings(catalog)
    assert postings.rdd.getNumPartitions() >= 20
    assert postings.count() == 200 * postings.where("parent_asin = 'P7'").count()
