"""Session stores: the stream against a plain store that takes one request after another."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.catalog import queries
from tessera.plans.sources import _arriving
from tessera.streaming import sessions as Z

T0 = dt.datetime(2024, 3, 1)


def plain(rows, ttl, most, turns, sliding, stores):
    """[(user, session, started, used, turns, status)] of each session at the end, by a dictionary for each store."""
    out, held = [], {k: {} for k in range(stores)}
    age = (lambda s: (s["used"], s["last"])) if sliding else (lambda s: (s["started"], s["first"]))
    ttl = dt.timedelta(minutes=ttl)

    def drop(store, key, status):
        s = store.pop(key)
        out.append((*key, s["started"], s["used"], s["turns"], status))

    for user, session, at, turn in sorted(rows, key=lambda r: (r[2], r[3])):
        store = held[user % stores]
        for key in [k for k, s in store.items() if at - age(s)[0] > ttl]:
            drop(store, key, "expired")
        for key in sorted(store, key=lambda k: age(store[k]))[: max(0, len(store) - most)]:
            drop(store, key, "evicted")
        s = store.setdefault((user, session), {"started": at, "first": turn, "turns": []})
        s |= {"used": at, "last": turn, "turns": [*s["turns"], turn][-turns:]}
    now = max(r[2] for r in rows)
    for store in held.values():
        for key in list(store):
            drop(store, key, "expired" if now - age(store[key])[0] > ttl else "live")
    return sorted(out)


@pytest.mark.parametrize(("sliding", "most"), [(True, 3), (False, 3), (True, 2000)])
def test_sessions(spark, sliding, most):
    rnd = random.Random(7)
    at, rows = T0, []
    for k in range(400):
        at += dt.timedelta(minutes=rnd.choice([0, 1, 3, 9, 20, 90]), microseconds=rnd.choice([0, 1]))
        rows.append((rnd.randint(1, 9), rnd.choice("ab"), at, k))
    df = spark.createDataFrame(rows, "user_id long, session string, at timestamp, turn_id long")
    with Z.rocksdb(spark):
        log = _arriving(spark, df, lambda s: Z.session_log(s, F.pmod("user_id", F.lit(2)), 60, most, turns=3, sliding=sliding), "at", ["user_id"], times=3, files=2)
    got = Z.ended(log, F.lit(max(r[2] for r in rows)), 60, sliding).collect()
    want = plain(rows, 60, most, 3, sliding, 2)
    assert sorted((r.user_id, r.session, r.started, r.used, list(r.turns), r.status) for r in got) == want
    kinds = {r[-1] for r in want}
    assert "expired" in kinds and ("evicted" in kinds) == (most == 3)
    assert Z.PROVIDER not in {k for k, _ in spark.sparkContext.getConf().getAll()}


def test_timers_fire_without_requests(spark):
    """A session of a store that has no further request is closed by its timer, once another store's requests have moved the watermark."""
    rows = [(0, "a", T0, 1), (0, "b", T0 + dt.timedelta(minutes=30), 2)] + [(1, "x", T0 + dt.timedelta(minutes=20 * k), 10 + k) for k in range(40)]
    df = spark.createDataFrame(rows, "user_id long, session string, at timestamp, turn_id long")
    with Z.rocksdb(spark):
        log = _arriving(spark, df, lambda s: Z.session_log(s, F.pmod("user_id", F.lit(2)), 60), "at", ["user_id"], times=2, files=1)
    gone = {(r.session, r.status, tuple(r.turns)) for r in log.filter("store = 0 and status <> 'live'").collect()}
    assert gone == {("a", "expired", (1,)), ("b", "expired", (2,))}


def test_quiz_stores_grow_with_the_users(spark, tmp_path):
    """More users at once than a fixed number of stores could hold: each keeps its session, as in the SQL of K3."""
    rows = [(n, T0 + dt.timedelta(seconds=n // 800), user, "c") for n, user in enumerate(k % 17_000 for k in range(34_000))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = queries()["K3_session_store"](spark, str(tmp_path))
    assert got.count() == 17_000
    assert [tuple(r) for r in got.groupBy("status", "requests").count().collect()] == [("live", 2, 17_000)]
    counts = []
    shelf = Z.Shelf(10, 2000, 10, False)
    for k in range(50):
        shelf.request((k, "a"), 100 * k, k)
        counts.append(len(shelf.touched & shelf.kept))
    assert counts[-1] == 0 and len(shelf.touched) == 50  # nothing of these is looked for in the state
