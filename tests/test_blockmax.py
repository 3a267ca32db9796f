"""Block-max search against scoring of every pair."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import blockmax as B
from lodestone.operators import retrieval as R
from lodestone.operators.search_index import build_index
from lodestone.session import shared_dir, write_table
from lodestone.sources.catalog import CATALOG_SCHEMA

PRODUCTS = 300


@pytest.fixture(scope="module")
def index(spark):
    draw = random.Random(2)
    common, rare = ["shoe", "wool", "red", "soft"], [f"w{i}" for i in range(40)]

    def words(n):
        return " ".join(draw.choice(common if draw.random() < 0.7 else rare) for _ in range(n))

    rows = [(f"P{i % 280:03d}{'x' * (i // 280)}", words(4), [words(3)], [words(draw.randint(0, 9))], "1", ["Top", words(1)], {"k": words(1)}, 4.0, 3, "Store")
            for i in range(PRODUCTS)]
    rows += [(f"T{i}", "shoe wool", ["red"], ["soft"], "1", ["Top", "shoe"], {"k": "red"}, 4.0, 3, "Store") for i in range(30)]  # ties
    found = build_index(spark.createDataFrame(rows, CATALOG_SCHEMA), buckets=4)
    # Ranges of 64 products, so that routing has something to choose from.
    return found, B.build_blocks(found.postings, found.documents, found.totals, shared_dir(spark), 64)


@pytest.fixture(scope="module")
def queries(spark):
    draw = random.Random(3)
    texts = ["shoe", "shoe wool", "shoe wool red soft", "store top", "w1", "w1 w2 w3", "unknown", "", "unknown shoe", "w5 store top shoe"]
    texts += [" ".join(draw.choice(["shoe", "wool", "red", "soft", "store", *[f"w{i}" for i in range(12)]]) for _ in range(draw.randint(1, 6))) for _ in range(40)]
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, query_text string")


def rows(df):
    return sorted((r.query_id, r["rank"], r.parent_asin, round(r.score, 8)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 10, 100, 1000])
def test_any_term(index, queries, k):
    full, blocks = index
    terms = R.explode_terms(queries)
    want = R.top_k(R.bm25_scores(full, terms), k, F.desc("score"), F.asc("parent_asin"))
    assert rows(B.search(blocks, terms, full.term_stats, k, products=64)) == rows(want)


@pytest.mark.parametrize("k", [3, 50])
def test_every_term(index, queries, k):
    full, blocks = index
    terms = R.explode_terms(queries, 16).where("n_terms >= 2")
    scores = R.bm25_scores(full, terms).where("matched_terms = n_terms")
    want = R.top_k(scores, k, F.desc("score"), F.asc("parent_asin"))
    assert rows(B.search(blocks, terms, full.term_stats, k, every=True, products=64)) == rows(want)


def test_few_pairs_are_scored(index, queries):
    """Rare terms decide: queries of one rare and several common words score a fraction of all pairs."""
    full, blocks = index
    terms = R.explode_terms(queries.where("query_text like 'w%'"))
    pairs = B.search(blocks, terms, full.term_stats, 3, products=64, counting=True)
    scored, asked = pairs.agg(F.sum("pairs"), F.count("*")).first()
    assert 0 < scored < 0.25 * asked * full.totals.first()["doc_count"]


def test_plan_filters_by_term(index, queries):
    full, blocks = index
    plan = blocks.blocks.where(F.col("term").isin("shoe", "w1"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan


def test_no_queries(index, queries):
    full, blocks = index
    assert B.search(blocks, R.explode_terms(queries.limit(0)), full.term_stats, 5, products=64).collect() == []


def test_ties_hand_on_a_few_k_rows(spark, queries):
    """Products of equal score in every range: each query hands on a few k rows, however many ranges there are."""
    catalog = spark.createDataFrame(
        [(f"P{i:05d}", "shoe wool", ["red"], ["soft"], "1", ["Top"], {"k": f"w{i % 3}"}, 4.0, 3, "Store") for i in range(2560)], CATALOG_SCHEMA)
    full = build_index(catalog, buckets=4)
    blocks = B.build_blocks(full.postings, full.documents, full.totals, shared_dir(spark), 64)
    asked = queries.where("query_text in ('shoe wool', 'w1', 'w1 w2 w3')")
    terms = R.explode_terms(asked)
    want = R.top_k(R.bm25_scores(full, terms), 100, F.desc("score"), F.asc("parent_asin"))
    told = []
    searched = B._searched

    def counted(*args):
        told.append(write_table(searched(*args), "told"))
        return told[-1]
    B._searched = counted
    try:
        assert rows(B.search(blocks, terms, full.term_stats, 100, products=64)) == rows(want)
    finally:
        B._searched = searched
    assert sum(t.count() for t in told) <= 6 * 100 * asked.count()


def test_copies_and_repeated_questions_are_answered_once(spark):
    """Copies of a product are one class and queries of the same known terms one request; every product and query is still told."""
    texts = [f"shoe wool w{i}" for i in range(12)]
    catalog = spark.createDataFrame(
        [(f"P{(7 * i) % 480:03d}", texts[i % 12], ["red"], ["soft"], "1", ["Top"], {"k": "x"}, 4.0, 3, "Store") for i in range(480)], CATALOG_SCHEMA)
    full = build_index(catalog, buckets=4)
    blocks = B.build_blocks(full.postings, full.documents, full.totals, shared_dir(spark), 8)
    assert blocks.blocks.agg(F.max("n")).first()[0] <= 8 and blocks.blocks.where("term = 'shoe'").agg(F.sum("n")).first()[0] == 12
    assert blocks.members.count() == 480
    asked = spark.createDataFrame([(f"q{i}", f"wool w{i % 3} unknown{i}") for i in range(60)], "query_id string, query_text string")
    terms, told = R.explode_terms(asked), []
    searched = B._searched

    def counted(*args):
        told.append(write_table(searched(*args), "told"))
        return told[-1]
    B._searched = counted
    try:
        for k in (1, 30, 100):
            want = R.top_k(R.bm25_scores(full, terms), k, F.desc("score"), F.asc("parent_asin"))
            assert rows(B.search(blocks, terms, full.term_stats, k, products=8)) == rows(want)
    finally:
        B._searched = searched
    assert max(t.select("q").distinct().count() for t in told) == 3
