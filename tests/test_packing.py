"""Places, components and batches that are worked out without one task for a group; late attempts; argument limits."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera import config
from tessera.operators import graph, questions, reviews
from tessera.operators.order import numbered
from tessera.plans.sources import _arriving
from tessera.streaming.reviews import review_updates


def packed(sizes, max_rows, max_chars):
    out, batch, n, total = [], 0, 0, 0
    for size in sizes:
        if n and (n >= max_rows or total + size + 96 > max_chars):
            batch, n, total = batch + 1, 0, 0
        n, total = n + 1, total + size + 96
        out.append(batch)
    return out


@pytest.mark.parametrize(("rows", "chars", "chunk"), [(20, 24000, 512), (3, 900, 8), (7, 500, 14), (1, 100, 2)])
def test_batches(spark, rows, chars, chunk):
    rnd = random.Random(rows)
    sizes = {"one": [rnd.choice([0, 5, 300, 4000, 30000]) for _ in range(1500)], "two": [10] * 45, None: [rnd.randint(0, 900) for _ in range(60)], "three": [7]}
    data = [(p, k, s) for p, own in sizes.items() for k, s in enumerate(own)]
    df = spark.createDataFrame(data, "part string, id long, chars long").repartition(6, F.rand(1))
    got = {(r.part, r.id): r.batch for r in questions.batches(df, rows, chars, chunk=chunk).collect()}
    assert got == {(p, k): b for p, own in sizes.items() for k, b in enumerate(packed(own, rows, chars))}
    assert questions.batches(df.limit(0)).count() == 0


def test_numbered(spark):
    rows = [("a", k % 50, k) for k in range(400)] + [("b", 1, 0), (None, 2, 0), (None, 1, 0)]
    df = spark.createDataFrame(rows, "g string, x long, y long").repartition(5, F.rand(2))
    found = {}
    for r in numbered(df, "g", "x", "y").collect():
        found.setdefault(r.g, []).append((r._n, r.x, r.y))
    assert {g: [(x, y) for _, x, y in sorted(v)] for g, v in found.items()} == {g: sorted((x, y) for h, x, y in rows if h == g) for g in ("a", "b", None)}
    assert all(sorted(n for n, _, _ in v) == list(range(len(v))) for v in found.values())


def test_connected(spark):
    rnd = random.Random(6)
    pairs = [(k, k + 1) for k in range(0, 300)] + [(rnd.randint(1000, 1100), rnd.randint(1000, 1100)) for _ in range(60)] + [(5000, 5000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in graph.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in pairs if a != b for n in (a, b)}


def test_late_attempts(spark):
    """Attempts come in any order; each takes its place as long as it is not behind the watermark."""
    rnd = random.Random(4)
    rows = [(k, 1 + k % 3, 1 + k % 2, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k // 3), rnd.randint(0, 5)) for k in range(60)]
    come = list(range(60))
    rnd.shuffle(come)
    df = spark.createDataFrame([(*r, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=c)) for r, c in zip(rows, come, strict=True)], "id long, user_id long, card_id long, attempted_at timestamp, quality int, come timestamp")
    columns = ["user_id", "card_id", "repetitions", "interval_days", F.round("ease_factor", 9), "lapses", "last_reviewed_at", "reviews"]
    want = sorted(tuple(r) for r in reviews.review_states(df.drop("come")).select(columns).collect())

    def ends(late):
        got = _arriving(spark, df, lambda s: review_updates(s, late), "come", ["user_id"], times=4, files=1)
        last = got.groupBy("user_id", "card_id").agg(F.max_by(F.struct("repetitions", "interval_days", "ease_factor", "lapses", "last_reviewed_at", "reviews"), "_batch").alias("s")).select("user_id", "card_id", "s.*")
        return sorted(tuple(r) for r in last.select(columns).collect())

    assert ends("5 days") == want
    left = ends("1 hour")  # what lies behind this watermark is left out
    assert sum(r[-1] for r in left) < 60


def test_late_attempts_of_many_cards(spark, tmp_path):
    """Users and cards of several rows of state, null ones among them; there are far fewer rows of state than (user, card)."""
    rnd = random.Random(5)
    cards = [None, 0, 1, 1023, 1024, 5000, (1 << 62) + 1]
    rows = [(k, rnd.choice([None, 0, 1, 31, 32, 99]), rnd.choice(cards), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randint(0, 50)), rnd.randint(0, 5), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.randint(0, 99))) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, user_id long, card_id long, attempted_at timestamp, quality int, come timestamp")
    columns = ["user_id", "card_id", "repetitions", "interval_days", F.round("ease_factor", 9).alias("ease"), "lapses", "last_reviewed_at", "reviews"]
    want = reviews.review_states(df.drop("come")).select(columns)
    got = _arriving(spark, df, lambda s: review_updates(s, "5 days"), "come", ["user_id"], times=3, files=2)
    last = got.groupBy("user_id", "card_id").agg(F.max_by(F.struct("repetitions", "interval_days", "ease_factor", "lapses", "last_reviewed_at", "reviews"), "_batch").alias("s")).select("user_id", "card_id", "s.*").select(columns)
    assert last.count() == want.count() == 42
    assert last.exceptAll(want).count() == 0
    stream = spark.readStream.schema("id long, user_id long, card_id long, attempted_at timestamp, quality int").parquet(str(tmp_path))
    analyzed = review_updates(stream)._jdf.queryExecution().analyzed().toString()
    assert "_users" in analyzed and "_cards" in analyzed  # no call for each (user, card)


def test_limits(spark):
    rows = [("q", 5, 20, "a", None, None, 0), ("", 0, 101, "a" * 4001, "c" * 65, "x" * 33, -1), (None, None, None, None, "c" * 64, "", None), ("q" * 2000, 20, 100, "", "", "dont_know", 7), ("q" * 2001, 21, 1, "a" * 4000, None, None, None)]
    df = spark.createDataFrame(rows, "query string, top_k int, n int, user_answer string, conversation_id string, action string, response_time_ms int")
    text = lambda c: (F.col(c), True)
    found = df.select(config.violations(query=text("query"), top_k=(F.col("top_k"), False), limit=(F.col("n"), False), user_answer=text("user_answer"), conversation_id=text("conversation_id"), action=text("action"), response_time_ms=(F.col("response_time_ms"), False)).alias("v")).collect()
    every = ["query", "top_k", "limit", "user_answer", "conversation_id", "action", "response_time_ms"]
    assert [r.v for r in found] == [[], every, every[:4], [], ["query", "top_k"]]
    with pytest.raises(ValueError, match="top_k"):
        config.RetrievalConfig(top_k=21)
    assert config.RetrievalConfig().depth == 20
