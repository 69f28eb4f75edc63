"""Tables that change: bucket tables, the mastery store, a relational database, the vector index."""

import datetime as dt
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.operators import reviews
from tessera.operators.mastery import MasteryStore
from tessera.operators.vector_index import VectorIndex
from tessera.sources import jdbc
from tessera.sources.buckets import BucketTable


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def plan_of(df):
    return df.sparkSession.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_bucket_table(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/t", "k bigint, v string, born int", ["k"], buckets=8)
    assert table.read().count() == 0
    rows = spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit(0).alias("born"))
    table.upsert(0, rows)
    before = files(f"{tmp_path}/t/data")
    change = spark.createDataFrame([(3, "b", 1), (3000, "b", 1), (None, "n", 1)], "k bigint, v string, born int")
    for _ in range(2):
        table.upsert(1, change, keep=("born",))
    after = files(f"{tmp_path}/t/data")
    assert all(after[f] == t for f, t in before.items())  # what was written stays
    assert len({f.split("bucket=")[1].split("/")[0] for f in set(after) - set(before)}) <= 3
    got = {r.k: (r.v, r.born) for r in table.read().collect()}
    assert len(got) == 202 and got[3] == ("b", 0) and got[3000] == ("b", 1) and got[4] == ("a", 0) and got[None] == ("n", 1)
    table.delete(2, spark.range(150).select(F.col("id").alias("k")))
    assert table.read().count() == 52
    table.upsert(2, change)  # the same number again stands in place of what it did before
    assert table.read().count() == 202
    table.delete(3, table.read().select("k").filter("k is not null"))
    assert [r.v for r in table.read().collect()] == ["n"]


def test_bucket_table_keeps_what_it_had_when_a_merge_fails(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/t", "k bigint, v string", ["k"], buckets=4)
    table.upsert(0, spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string"))
    with pytest.raises(Exception, match="no such luck"):
        table.upsert(1, spark.range(3).select(F.col("id").alias("k"), F.when(F.col("id") > 5, F.lit("x")).otherwise(F.raise_error(F.lit("no such luck"))).alias("v")))
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, "a"), (2, "b")]


def test_mastery_by_batches(spark, tmp_path):
    rnd, t0 = random.Random(2), dt.datetime(2024, 1, 1)
    rows = [(k, rnd.choice([1, 1, 1, 2, 3]), rnd.randint(1, 6), t0 + dt.timedelta(hours=k // 2), rnd.randint(0, 5)) for k in range(120)]
    schema = "id long, user_id long, card_id long, attempted_at timestamp, quality int"
    attempts = spark.createDataFrame(rows, schema)
    identities = spark.createDataFrame([(c, "os", f"t{c % 3}") for c in range(1, 6)], "card_id long, subject string, topic_key string")  # card 6 has none
    now = F.lit("2024-01-05 00:00:00").cast("timestamp")
    store = MasteryStore(spark, f"file://{tmp_path}/m", buckets=3)
    for batch, (a, b) in enumerate(((0, 50), (50, 51), (51, 120))):
        for _ in range(2):
            store.refresh(batch, attempts.filter(F.col("id").between(a, b - 1)), identities, now)
        so_far = attempts.filter(F.col("id") < b)
        whole = reviews.swot(reviews.mastery(so_far, reviews.review_states(so_far), identities, now)).filter("attempt_count > 0")
        columns = ["user_id", "subject", "topic_key", "attempt_count", "lapse_count", "due_count", "overdue_count", *(F.round(c, 9).alias(c) for c in ("mastery", "strength", "weakness", "opportunity", "threat"))]
        assert sorted(tuple(r) for r in store.topics.read().select(*columns, "bucket_name").collect()) == sorted(tuple(r) for r in whole.select(*columns, "bucket").collect())
        assert store.states.read().count() == so_far.select("user_id", "card_id").distinct().count()
    last = {(r.user_id, r.topic_key): (r.created, r.updated) for r in store.topics.read().collect()}
    assert {u for _, u in last.values()} == {2} and min(c for c, _ in last.values()) == 0


def test_database(spark, tmp_path):
    db = jdbc.derby(spark, f"file://{tmp_path}/db")
    schema = "k bigint, name string, price decimal(9,2), n int, made timestamp, born int"
    rows = spark.createDataFrame([(k, f"it's {k}" if k % 5 else None, None, k % 7, dt.datetime(2024, 1, 1, k % 24), 0) for k in range(1, 301)], schema)
    db.create("items", rows.schema, ["k"])
    db.append(rows.repartition(4), "items")
    change = spark.createDataFrame([(5, "new", None, 1, None, 9), (5, "new", None, 1, None, 9), (1000, "far", None, 2, None, 9)], schema)
    for _ in range(2):
        assert db.upsert(change, "items", ["k"], keep=["born"]) == 2
    whole = db.read("items", "k", 6)
    assert whole.count() == 301 and whole.rdd.getNumPartitions() == 6
    got = {r.K: (r.NAME, r.BORN) for r in whole.collect()}
    assert got[5] == ("new", 0) and got[1000] == ("far", 9) and got[7] == ("it's 7", 0) and got[10] == (None, 0)
    plan = plan_of(whole.filter("N = 3 and K > 100").select("K"))
    assert "*EqualTo(N,3), *GreaterThan(K,100)]" in plan and "ReadSchema: struct<K:bigint>" in plan
    name = db.catalog("shop")
    assert {r.tableName for r in db.tables(name, "APP").collect()} == {"ITEMS"}  # no staging table is left
    counted = spark.table(f"{name}.APP.ITEMS").filter("N = 3").agg(F.count("*").alias("n"))
    assert "COUNT(*)" in plan_of(counted) and "PushedAggregates" in plan_of(counted) and counted.first().n == rows.filter("n = 3").count()
    db.create("nothing", rows.schema)
    assert db.read("nothing", "k").count() == 0
    with pytest.raises(Exception, match="(?i)constraint|null"):
        db.upsert(spark.createDataFrame([(None, "x", None, 1, None, 1)], schema), "items", ["k"])
    assert db.read("items").count() == 301 and db.tables(name, "APP").count() == 2
    with pytest.raises(ValueError, match="plain name"):
        db.create("items; drop table items", rows.schema)


def vectors(rnd, n, width=24, clusters=40):
    middles = rnd.normal(size=(clusters, width))
    return middles[rnd.integers(0, clusters, n)] + rnd.normal(size=(n, width)) * 0.5


def test_vector_index(spark, tmp_path):
    rnd = np.random.default_rng(5)
    x = vectors(rnd, 3000)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(9000, None), (9001, [1.0, 2.0]), (9002, [0.0] * 24)], "id long, v array<double>")
    index = VectorIndex.build(rows, f"file://{tmp_path}/i", lists=50, sample=1000)
    asked = rows.filter("id % 20 = 0 and id < 3000").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    some = rows.filter("id < 3000")
    exact = {(r.query_id, r.id) for r in R.dense(some, asked, 10).collect()}
    found = index.search(asked, 10, probes=8)
    got = {(r.query_id, r.id) for r in found.collect()}
    assert len(got & exact) / len(exact) >= 0.9
    whole = {tuple(r) for r in index.search(asked, 10, probes=50).select("query_id", "rank", "id", F.round("score", 5)).collect()}
    assert whole == {tuple(r) for r in R.dense(some, asked, 10).select("query_id", "rank", "id", F.round("score", 5)).collect()}
    one = asked.filter("query_id = 40")
    assert re.search(r"PartitionFilters: \[.*list#\d+ IN \(\d+,\d+\)", plan_of(index.search(one, 3, probes=2)))
    # inserts, replacements and removals without training; a batch that is repeated counts once
    before = index.centroids.copy()
    more = spark.createDataFrame([(5000 + k, (-v).tolist()) for k, v in enumerate(x[:40])] + [(1, x[40].tolist())], "id long, v array<double>")
    for _ in range(2):
        index.insert(more, 1)
    index.remove(spark.createDataFrame([(60,)], "id long"), 2)
    again = VectorIndex(spark, f"file://{tmp_path}/i")
    assert (again.centroids == before).all()
    now = some.filter("id not in (1, 60)").unionByName(more)
    assert again.rows().count() == now.count()
    assert {tuple(r) for r in again.search(asked, 5, probes=50).select("query_id", "rank", "id").collect()} == {tuple(r) for r in R.dense(now, asked, 5).select("query_id", "rank", "id").collect()}


def test_vector_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id long, v array<double>")
    index = VectorIndex.build(none, f"file://{tmp_path}/i")
    assert index.search(none.withColumnRenamed("id", "query_id").withColumnRenamed("v", "q")).count() == 0


def test_dense_in_blocks(spark, monkeypatch):
    """More queries than are sent to the rows: the same rows as from the few, with copies, missing and odd vectors, and ids that are no numbers; scores are worked out in small tiles."""
    rnd = np.random.default_rng(9)
    x = np.concatenate([vectors(rnd, 700), np.ones((300, 24)), vectors(rnd, 200)])
    odd = [("n", None), ("w", [1.0, 2.0]), ("z", [0.0] * 24), ("i", [float("nan")] * 24)]
    rows = spark.createDataFrame([(f"r{k:04d}", v.tolist()) for k, v in enumerate(x)] + odd, "id string, v array<double>").repartition(3)
    asked = rows.filter("id like '%0' or id in ('n', 'z')").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    score = np.round(unit @ unit.T, 6)
    want = {(f"r{q:04d}", n + 1, f"r{r:04d}") for q in range(0, len(x), 10) for n, r in enumerate(sorted(range(len(x)), key=lambda r, q=q: (-score[q, r], r))[:7])}
    plain = R.dense(rows, asked, 7)
    assert {(r.query_id, r.rank, r.id) for r in plain.collect()} == want
    monkeypatch.setattr(R, "FEW_QUERIES", 24 * 10)
    monkeypatch.setattr(R, "TILE", 1000)
    monkeypatch.setattr(R, "BLOCK", 24 * 100)
    blocked = R.dense(rows, asked, 7)
    assert {(r.query_id, r.rank, r.id) for r in blocked.collect()} == want
    plan = plan_of(blocked)
    assert "MapInArrow" in plan and "Join" not in plan  # no pair of a row and a query is a row of Spark's
    assert R.dense(rows, asked.filter("false"), 7).count() == 0


def test_dense_keeps_little(monkeypatch):
    """Of very many equal rows the first k for each query go on, and a tile is all that is held beside."""
    monkeypatch.setattr(R, "TILE", 4096)
    rows, wanted = np.ones((20_000, 4)) / 2, np.ones((64, 4)) / 2
    found = list(R._best(rows, wanted, 5))
    assert sum(len(q) for q, _, _ in found) == 64 * 5
    assert all(set(r) == set(range(5)) for _, r, _ in found)


WORDS = "router packet kernel thread index query cache page frame stack queue lock mutex signal handler the and of".split()


def test_kept_postings(spark, tmp_path):
    from tessera.operators.postings_index import PostingsIndex

    rnd = random.Random(3)
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    index, now = PostingsIndex(spark, f"file://{tmp_path}/p", buckets=8), {}
    asked = spark.createDataFrame([(k, say(4)) for k in range(12)] + [(99, ""), (98, "unheard words")], "query_id long, query string")

    def check():
        chunks = spark.createDataFrame(sorted(now.items()), "id long, text string")
        toks = R.tokenized(chunks)
        want = {tuple(r) for r in R.bm25(toks, asked, 5).select("query_id", "rank", "id", F.round("score", 6)).collect()}
        assert {tuple(r) for r in index.search(asked, 5).select("query_id", "rank", "id", F.round("score", 6)).collect()} == want
        stats = lambda df: sorted((r.tok, r.df, round(r.idf, 9)) for r in df.collect())
        assert stats(index.statistics()) == stats(R.bm25_statistics(toks)[0])

    for batch in range(4):
        add = {rnd.randint(0, 60): say(rnd.randint(0, 12)) for _ in range(25)}
        remove = [k for k in list(now) if rnd.random() < 0.2 and k not in add] if batch else []
        for _ in range(1 + batch % 2):  # a batch may be written again
            index.apply(batch, spark.createDataFrame(sorted(add.items()), "id long, text string"), spark.createDataFrame([(k,) for k in remove], "id long") if remove else None)
        for k in remove:
            del now[k]
        now |= add
        check()
    index.apply(4, remove=spark.createDataFrame([(k,) for k in list(now)[:5]], "id long"))
    for k in list(now)[:5]:
        del now[k]
    check()
    one = index.postings(spark.createDataFrame([("kernel",)], "tok string"))
    plan = plan_of(one)
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ = \d", plan) and "EqualTo(tok,kernel)" in plan
    held = spark.read.parquet(f"file://{tmp_path}/p/postings")
    there = held.filter(F.col("bucket") == F.pmod(F.xxhash64(F.lit("kernel")), F.lit(8))).select(F.input_file_name()).distinct().count()
    assert there < len(files(f"{tmp_path}/p/postings")) / 2  # bytes that a search doesn't read


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_recall_on_the_given_vectors(spark):
    from tessera import catalog
    from tessera.plans.retrieval import _vectors

    sf = "/root/testdata/sf0.001"
    exact = {(r.query_id, r.id) for r in R.dense(*_vectors(spark, sf), 5).collect()}
    found = {(r.query_id, r.id) for r in catalog.queries()["I20_inverted_file_search"](spark, sf).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
