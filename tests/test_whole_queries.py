"""Queries over all rows, on tables beyond the limits that older queries' SQL has."""

import decimal
import math
import random

from tessera import catalog
from tessera.plans.retrieval import key_terms


def test_resume_all_parts(spark, tmp_path):
    spark.range(3990, 4020).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(3995,), (4001,), (4019,), (9000,)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.id: r.n for r in catalog.queries()["A9_resume_all_parts"](spark, str(tmp_path)).collect()}
    assert got == {i: i if i in (3995, 4001, 4019) else None for i in range(3990, 4020)}


def test_search_all_vectors(spark, tmp_path):
    rows = [(0, [1.0, 0.0]), (3, [1.0, 0.01]), (4, None), (10, [1.0, 0.02]), (20, None), (21, [0.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.query_id, r["rank"], r.id) for r in catalog.queries()["I20_search_all_vectors"](spark, str(tmp_path)).collect())
    assert got == [(0, 1, 0), (0, 2, 3), (0, 3, 10), (0, 4, 21)]


def test_mean_relevance_in_order_of_rank(spark, tmp_path):
    """Means that lie half-way between two roundings: the scores are summed by rank, however rows come. Sixty groups of twenty vectors, each group in a plane of its own."""
    rnd, rows, want = random.Random(11), [], {}
    for g in range(60):
        scores = [1.0]
        while len(scores) != 20 or round(sum(scores) * 1e6) % 200 != 100:
            scores = [1.0, *sorted((k / 1e6 for k in rnd.sample(range(200_000, 999_000), 19)), reverse=True)]
        at = list(zip(rnd.sample(range(20 * g + 1, 20 * g + 20), 19), scores[1:], strict=True))
        for k, c in [(20 * g, 1.0), *at]:
            v = [0.0] * 120
            v[2 * g], v[2 * g + 1] = c, math.sqrt(1 - c * c)
            rows.append((k, v, k % 3))
        total = 0.0
        for c in scores:
            total += c
        want[20 * g] = float(decimal.Decimal(repr(total / 20)).quantize(decimal.Decimal("0.00001"), decimal.ROUND_HALF_UP))
    rnd.shuffle(rows)
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # labels are joined by sorting, as those of larger tables
    try:
        found = catalog.queries()["I3_dense_relevance"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert {r.query_id: r.mean_score for r in found} == want
    assert all(r.same_label == sum(k % 3 == r.query_id % 3 for k in range(r.query_id, r.query_id + 20)) for r in found)


def test_key_terms(spark):
    """The most frequent words, ties by first place, counted where texts are read; ids that occur twice count as one chunk."""
    rows = [(1, "beta alpha beta gamma alpha delta"), (2, None), (3, "the of"), (None, "alone"), (4, " ".join(f"w{k:02d}" for k in range(30)) + " w29 w28")]
    once = key_terms(spark.createDataFrame(rows, "id long, text string"), 3)
    want = {1: ["beta", "alpha", "gamma"], None: ["alone"], 4: ["w28", "w29", "w00"]}
    assert {r.id: list(r.key_terms) for r in once.collect()} == want
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()  # no word is shuffled
    again = key_terms(spark.createDataFrame([*rows, (1, "delta delta")], "id long, text string"), 3)
    assert {r.id: list(r.key_terms) for r in again.collect()} == want | {1: ["delta", "beta", "alpha"]}
