"""Cell-pruned vector search, hybrid ranking and the encoder hook."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval as R
from lodestone.operators import scoring as SC
from lodestone.operators import vectors as D
from lodestone.sources import catalog as C


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 8))
    points = centres[draw.integers(0, 12, 500)] + 0.1 * draw.normal(size=(500, 8))
    points = np.concatenate([points, points[:40]])  # ties
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(f"P{i:03d}", p.tolist()) for i, p in enumerate(points)], "parent_asin string, embedding array<double>")
    asked = np.concatenate([centres[:6], draw.normal(size=(6, 8))])
    queries = spark.createDataFrame([(f"q{i:02d}", q.tolist()) for i, q in enumerate(asked)], "query_id string, embedding array<double>")
    return vectors, queries


def rows(df):
    return sorted((r.query_id, r["rank"], r.parent_asin, r.similarity) for r in df.collect())


@pytest.mark.parametrize("k,cells,part", [(1, None, 4096), (10, None, 16), (100, 7, 16), (1000, 3, 4096)])
def test_cells_give_the_exact_best(table, monkeypatch, k, cells, part):
    monkeypatch.setattr(D, "CELL_PART", part)
    monkeypatch.setattr(D, "CELL_QUERIES", 5)
    vectors, queries = table
    assert rows(D.cell_topk(D.build_cells(vectors, cells), queries, k, 8)) == rows(D.dense_topk(vectors, queries, k, 8))


def test_most_cells_are_skipped(table):
    vectors, queries = table
    index = D.build_cells(vectors)
    near = D.normalized_queries(queries.limit(6), 8)
    bounds = D._cell_bounds(index, near)
    kth = D.dense_topk(vectors, queries, 5, 8).where("rank = 5").select("query_id", "similarity")
    read = bounds.join(kth, "query_id").where("bound >= similarity").agg(F.sum("vectors")).first()[0]
    assert read < 0.5 * near.count() * vectors.count()


def test_empty(spark, table):
    vectors, queries = table
    assert D.cell_topk(D.build_cells(vectors.limit(0)), queries, 3, 8).collect() == []
    assert D.cell_topk(D.build_cells(vectors), queries.limit(0), 3, 8).collect() == []


def test_hybrid_with_an_encoder(spark, catalog):
    """An encoder's query vectors, both intents, a product that only its vector finds, against blending of every candidate."""
    encode = D.query_encoder(lambda texts: [[1.0, float(len(t)) / 20, 0.0] for t in texts])
    queries = spark.createDataFrame(
        [("a", "buying", "Women Shoes", ["leather"], None, None), ("b", "browsing", "Women Shoes", ["red"], 50.0, True), ("c", "browsing", "Women Boots", [], None, None)],
        "query_id string, intent string, category string, constraints array<string>, budget_max double, budget_hard boolean")
    encoded = queries.select("query_id", encode(F.col("category")).alias("embedding"))
    products = C.products(catalog)
    stats = C.catalog_stats(products)
    vectors = spark.createDataFrame([(f"P{i}", v) for i, v in enumerate([[1.0, 0.0, 0.0], [0.6, 0.8, 0.0], [0.0, 1.0, 0.0], [0.8, 0.6, 0.0]])], "parent_asin string, embedding array<double>")
    lexical = spark.createDataFrame([("a", "P0", 1), ("a", "P3", 2), ("b", "P3", 1), ("c", "P5", 1)], "query_id string, parent_asin string, rank int")
    dense = D.dense_scores(D.cell_topk(D.build_cells(vectors), encoded, 2, 3))
    everything = D.hybrid_pool(R.candidate_union(lexical, R.category_route(queries, products)), dense)
    known = queries.select("query_id", (F.size("constraints") > 0).alias("has_constraints"))
    want = D.hybrid_rank(SC.score_candidates(everything, queries, products, stats), dense, known).where("rank <= 3")
    got = D.hybrid_topk(lexical, dense, queries, products, stats, 3, 2)
    pick = lambda df: sorted((r.query_id, r["rank"], r.parent_asin, r.score, r.dense_score) for r in df.collect())
    assert pick(got) == pick(want) and len(pick(got)) == 9
    with pytest.raises(ValueError):
        D.hybrid_rank(everything, dense, known, {"buying": 1.0, "browsing": 0.1})
