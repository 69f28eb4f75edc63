"""Session stores as streaming state: sessions end by timers, and a store holds a bounded number of them.

A store is one key of the state; it stands for what one server holds in memory, and stores are dealt to the tasks. Its
sessions are a map in RocksDB, so a trigger reads and writes the sessions of stores that had requests or timers only.
Two rules for a session's age are built: since it was last used (chat memory), and since it was started (quiz sessions).
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUT = "store long, user_id long, session string, started timestamp, used timestamp, requests long, turns array<long>, status string, ord long"
_KEY = "user_id long, session string"
_VALUE = "started long, started_id long, used long, used_id long, requests long, turns array<long>"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, which state with timers needs; the session's setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class Session:
    """When it was started and last used (microseconds and request), how many requests it had, and the last turns."""

    __slots__ = ("started", "started_id", "used", "used_id", "requests", "turns")

    def __init__(self, started: int, started_id: int, used: int, used_id: int, requests: int = 0, turns: list[int] | None = None):
        self.started, self.started_id, self.used, self.used_id, self.requests, self.turns = started, started_id, used, used_id, requests, turns or []

    def value(self) -> tuple:
        return self.started, self.started_id, self.used, self.used_id, self.requests, self.turns


class Shelf:
    """The sessions of one store in order of age, oldest first."""

    def __init__(self, ttl: int, most: int, turns: int, sliding: bool, found: dict[tuple, Session] | None = None):
        self.ttl, self.most, self.turns, self.sliding = ttl, most, turns, sliding
        order = (lambda s: (s.used, s.used_id)) if sliding else (lambda s: (s.started, s.started_id))
        self.held: OrderedDict[tuple, Session] = OrderedDict(sorted((found or {}).items(), key=lambda kv: order(kv[1])))
        self.kept, self.touched = set(self.held), set()  # what the state holds, and what is another now
        self.log: list[tuple[tuple, Session, str]] = []  # of what went, in order

    def _age(self, s: Session) -> int:
        return s.used if self.sliding else s.started

    def _gone(self, status: str) -> None:
        key, s = self.held.popitem(last=False)
        self.log.append((key, s, status))
        self.touched.add(key)

    def expire(self, now: int) -> None:
        while self.held and now - self._age(next(iter(self.held.values()))) > self.ttl:
            self._gone("expired")

    def request(self, key: tuple, now: int, turn: int) -> None:
        """First what is too old goes, then the oldest beyond the bound; then the request finds or makes its session."""
        self.expire(now)
        while len(self.held) > self.most:
            self._gone("evicted")
        s = self.held.get(key)
        if s is None:
            s = self.held[key] = Session(now, turn, now, turn)
        s.used, s.used_id, s.requests = now, turn, s.requests + 1
        s.turns = [*s.turns, turn][-self.turns :]
        if self.sliding:
            self.held.move_to_end(key)
        self.touched.add(key)

    def next_expiry(self) -> int | None:
        """The first microsecond at which the oldest session is too old."""
        return self._age(next(iter(self.held.values()))) + self.ttl + 1 if self.held else None


class Store(StatefulProcessor):
    def __init__(self, ttl: int, most: int, turns: int, sliding: bool):
        self.rules = (ttl, most, turns, sliding)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getMapState("sessions", _KEY, _VALUE)

    def close(self) -> None:
        return

    def _shelf(self) -> Shelf:
        return Shelf(*self.rules, {tuple(k): Session(*v[:5], list(v[5])) for k, v in self.sessions.iterator()})

    def _settled(self, key: tuple, shelf: Shelf) -> Iterator[pd.DataFrame]:
        """Writes what has changed, sets the timer for the session that is too old next, and hands on what happened."""
        for k in shelf.touched:
            if k in shelf.held:
                self.sessions.updateValue(k, shelf.held[k].value())
            elif k in shelf.kept:  # most sessions come and go within one trigger; asking the state for each is a round trip
                self.sessions.removeKey(k)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        after = shelf.next_expiry()
        if after is not None:
            self.handle.registerTimer(-(-after // 1000))
        rows = [*shelf.log, *((k, shelf.held[k], "live") for k in shelf.held if k in shelf.touched)]
        if rows:
            at = [(key[0], *k, pd.Timestamp(s.started, unit="us"), pd.Timestamp(s.used, unit="us"), s.requests, s.turns, status, n) for n, (k, s, status) in enumerate(rows)]
            yield pd.DataFrame(at, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        shelf = self._shelf()
        found = pd.concat([r for r in rows if len(r)]).sort_values(["micros", "turn_id"])
        for user, session, now, turn in zip(found["user_id"], found["session"], found["micros"], found["turn_id"], strict=True):
            shelf.request((int(user), session), int(now), int(turn))
        yield from self._settled(key, shelf)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        shelf = self._shelf()
        shelf.expire(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        yield from self._settled(key, shelf)


def session_log(requests: DataFrame, store: Column, ttl_minutes: int, most: int = 2000, turns: int = 10, sliding: bool = True, late: str = "10 minutes") -> DataFrame:
    """A stream of requests(user_id, session, at, turn_id) -> what became of sessions, by store and trigger: live, expired or evicted.

    Requests of a trigger are taken in order of time and turn_id; those that lie behind the watermark are left out. A session is too old more than
    ttl_minutes after its last use (sliding) or its start. A request finds at most `most` sessions in its store, the oldest go first. Start the stream inside rocksdb().
    """
    rows = requests.select(F.col("at").cast("timestamp").alias("at"), "user_id", "session", "turn_id").withWatermark("at", late)
    rows = rows.withColumns({"store": store.cast("long"), "micros": F.unix_micros("at")})
    return rows.groupBy("store").transformWithStateInPandas(Store(ttl_minutes * 60_000_000, most, turns, sliding), OUT, "Update", "EventTime")


def ended(log: DataFrame, now: Column, ttl_minutes: int, sliding: bool = True) -> DataFrame:
    """From a log with _batch, the trigger's number: each session once, as it stands at the time `now`."""
    last = log.groupBy("user_id", "session", "started").agg(F.max_by(F.struct("used", "requests", "turns", "status"), F.struct("_batch", "ord")).alias("s")).select("user_id", "session", "started", "s.*")
    age = F.unix_micros(now) - F.unix_micros("used" if sliding else "started")
    return last.withColumn("status", F.when((F.col("status") == "live") & (age > ttl_minutes * 60_000_000), F.lit("expired")).otherwise(F.col("status")))
