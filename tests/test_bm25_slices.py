"""BM25 where texts lie, against postings and sums; neighbours by ranges of a book."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval as R


@pytest.fixture
def corpus(spark):
    pick = random.Random(7)
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(pick.choices(words, [1 / (1 + i) for i in range(60)], k=pick.choice((0, 3, 40)))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:1] * 40)]  # copies tie
    queries = [(i, " ".join(pick.choices(words, k=4)) + (" word3 word3" if i % 2 else " unknown")) for i in range(30)] + [(98, ""), (99, texts[0])]
    return spark.createDataFrame(rows, "id long, text string").repartition(5), spark.createDataFrame(queries, "query_id long, query string")


def _rows(df):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_slices_of_texts_equal_postings(corpus, monkeypatch, k):
    chunks, queries = corpus
    want = _rows(R.ranked(R.bm25_scores(chunks, queries), k))
    monkeypatch.setattr(R, "TILE", 500)  # several slices a batch, several pieces a slice
    assert _rows(R.bm25(chunks, queries, k)) == want and want


def test_no_posting_is_shuffled(corpus):
    chunks, queries = corpus
    plan = R.bm25(chunks, queries, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "MapInArrow" in plan  # the k best of each batch, by query


def test_many_terms_and_shared_ids_go_by_postings(corpus, monkeypatch):
    chunks, queries = corpus
    twice = chunks.withColumn("id", F.col("id") % 200)
    assert _rows(R.bm25(twice, queries, 3)) == _rows(R.ranked(R.bm25_scores(twice, queries), 3))
    monkeypatch.setattr(R, "FEW_ASKED", 10)
    assert "MapInArrow" not in R.bm25(chunks, queries, 5)._jdf.queryExecution().executedPlan().toString()
    assert R.bm25(chunks.limit(0), queries, 5).count() == 0 and R.bm25(chunks, queries.limit(0), 5).count() == 0


def test_neighbours_number_no_book_in_one_task(spark):
    chunks = spark.range(400).select("id", F.when(F.col("id") % 4 > 0, F.lit("a")).alias("book_id"), (1000 - F.col("id")).alias("pos")).repartition(7)
    found = R.neighbours(chunks, spark.createDataFrame([(1, 10, 1), (1, 8, 2), (2, 399, 1)], "query_id long, id long, rank int"))
    assert sorted((r.query_id, r.position, r.id) for r in found.collect()) == [(1, 1, 11), (1, 2, 10), (1, 3, 9), (2, 1, 399), (2, 2, 398)]
    assert "Window [row_number() windowspecdefinition(book_id" not in found._jdf.queryExecution().toString()
