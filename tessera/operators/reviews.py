"""Spaced repetition: the review state fold, due and new cards, statistics, mastery and strengths.

Histories are folded as one sorted array for each (user, card); everything else is joins and conditional aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamp, first_of
from ..sources.shared import written
from .order import numbered

STATE = "struct<repetitions:int,interval_days:int,ease_factor:double,lapses:int>"


def next_state(s: Column, q: Column) -> Column:
    """One review of quality q (0 to 5; anything else is an error) applied to a state; ease 0 or null counts as 2.5."""
    ease = F.coalesce(F.nullif(s["ease_factor"], F.lit(0.0)), F.lit(2.5))
    reps, days = F.coalesce(s["repetitions"], F.lit(0)), F.coalesce(s["interval_days"], F.lit(0))
    lapses = F.coalesce(s["lapses"], F.lit(0))
    better = F.greatest(F.lit(1.3), ease + (0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)))
    grown = F.when(days == 0, F.lit(6)).otherwise(F.greatest(F.lit(1), F.bround(days * better, 0).cast("int")))
    passed = F.struct(
        (reps + 1).alias("repetitions"), F.when(reps == 0, F.lit(1)).when(reps == 1, F.lit(6)).otherwise(grown).alias("interval_days"), better.alias("ease_factor"), lapses.alias("lapses")
    )
    back = F.when(days > 1, F.greatest(F.lit(1), F.least(F.floor(days / 2).cast("int"), F.lit(7)))).otherwise(F.lit(1))
    failed = F.struct(F.lit(0).alias("repetitions"), back.alias("interval_days"), ease.alias("ease_factor"), (lapses + 1).alias("lapses"))
    wrong = F.raise_error(F.concat(F.lit("quality must be 0 to 5, not "), q.cast("string"))).cast(STATE)
    return F.when((q < 0) | (q > 5), wrong).when(q < 3, failed.cast(STATE)).otherwise(passed.cast(STATE))


def review_states(attempts: DataFrame) -> DataFrame:
    """attempts(id, user_id, card_id, attempted_at, quality) -> the state of each (user, card) after its last review."""
    start = F.struct(F.lit(0).alias("repetitions"), F.lit(0).alias("interval_days"), F.lit(2.5).alias("ease_factor"), F.lit(0).alias("lapses")).cast(STATE)
    histories = attempts.groupBy("user_id", "card_id").agg(
        F.array_sort(F.collect_list(F.struct("attempted_at", "id", "quality"))).alias("h"), F.max("attempted_at").alias("last_reviewed_at"), F.count("*").alias("reviews")
    )
    folded = histories.withColumn("s", F.aggregate("h", start, lambda s, a: next_state(s, a["quality"])))
    return folded.select("user_id", "card_id", "s.*", "last_reviewed_at", (F.col("last_reviewed_at") + F.make_dt_interval(days=F.col("s.interval_days"))).alias("due_at"), "reviews")


def next_cards(users: DataFrame, cards: DataFrame, states: DataFrame, now: Column, limit: int = 20) -> DataFrame:
    """For each user the cards that are due, earliest first, then new ones by id, `limit` together (20 if it is not positive)."""
    limit = limit if limit and limit > 0 else 20
    due = states.filter(F.col("due_at") <= now).join(cards.select(F.col("id").alias("card_id")), "card_id", "left_semi").select("user_id", "card_id", F.lit(0).alias("new"), "due_at")
    ids = cards.select(F.col("id").alias("card_id"))
    fresh = _fresh(users, ids, states, limit)
    order = Window.partitionBy("user_id").orderBy("new", "due_at", "card_id")
    both = due.unionByName(fresh.select("user_id", "card_id", F.lit(1).alias("new"), F.lit(None).cast("timestamp").alias("due_at")))
    return both.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit).select("user_id", "position", "card_id", (F.col("new") == 1).alias("is_new"))


def _fresh(users: DataFrame, ids: DataFrame, states: DataFrame, limit: int) -> DataFrame:
    """The first `limit` cards by id without a state, for each user, without pairing users with cards.

    Ranked by id, the k-th card that a user has seen has rank r_k; before it there are r_k - k unseen ones. Gaps between seen ranks
    give the unseen ranks as ranges, which are cut at `limit` and only then spelled out.
    """
    ranked = written(numbered(ids.withColumn("_all", F.lit(0)), "_all", "card_id").select("card_id", (F.col("_n") + 1).alias("r")))
    total = ranked.agg(F.max("r").alias("total"))
    seen = states.select("user_id", "card_id").join(ranked, "card_id").select("user_id", "r").distinct()
    ends = users.select("user_id").crossJoin(F.broadcast(total)).select("user_id", (F.col("total") + 1).alias("r"))  # one row of totals
    order = Window.partitionBy("user_id").orderBy("r")
    gaps = seen.unionByName(ends).withColumn("after", F.coalesce(F.lag("r").over(order), F.lit(0))).withColumn("k", F.row_number().over(order))
    before = F.col("after") - (F.col("k") - 1)  # unseen ranks up to here
    ranges = gaps.filter((F.col("r") > F.col("after") + 1) & (before < limit)).select("user_id", (F.col("after") + 1).alias("a"), F.least(F.col("r") - 1, F.col("after") + (limit - before)).alias("b"))
    return ranges.select("user_id", F.explode(F.sequence("a", "b")).alias("r")).join(ranked, "r").select("user_id", "card_id")


def topic_stats(cards: DataFrame, topics: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """(user_id, topic, total, learned, due_today, overdue) of the topics in which the user has a state; due by calendar date."""
    named = cards.select(F.col("id").alias("card_id"), "topic_id").join(topics.select(F.col("id").alias("topic_id"), "name"), "topic_id", "left").withColumn("topic", F.coalesce("name", F.lit("unknown")))
    totals = named.groupBy("topic").agg(F.count("*").alias("total"))
    day, today = F.to_date("due_at"), F.to_date(now)
    own = states.join(named, "card_id").groupBy("user_id", "topic").agg(
        F.count_if(F.col("repetitions") > 0).alias("learned"), F.count_if(day == today).alias("due_today"), F.count_if(day < today).alias("overdue")
    )
    return own.join(totals, "topic").select("user_id", "topic", "total", "learned", "due_today", "overdue")


def recent_trend(attempts: DataFrame, window: int = 3) -> DataFrame:
    """attempts with subject and topic_key -> count, average quality and how the last `window` differ from it."""
    order = Window.partitionBy("user_id", "subject", "topic_key").orderBy(F.desc("attempted_at"), F.desc("id"))
    ranked = attempts.withColumn("r", F.row_number().over(order))
    return ranked.groupBy("user_id", "subject", "topic_key").agg(
        F.count("*").alias("attempt_count"), F.avg("quality").alias("avg_quality"), (F.avg(F.when(F.col("r") <= window, F.col("quality"))) - F.avg("quality")).alias("recent_trend"), F.max("attempted_at").alias("last_reviewed_at")
    )


def mastery(attempts: DataFrame, states: DataFrame, identities: DataFrame, now: Column) -> DataFrame:
    """Mastery of every topic for every user who has an attempt or a state: all topics of all cards, also those never tried."""
    topics = identities.select("subject", "topic_key").distinct()
    tried = recent_trend(attempts.join(identities, "card_id"))
    held = states.join(identities, "card_id").groupBy("user_id", "subject", "topic_key").agg(*held_counts(now))
    users = attempts.select("user_id").union(states.select("user_id")).distinct()
    # the result has a row for every user and topic, so the pairing is the result itself
    rows = users.crossJoin(topics).join(tried, ["user_id", "subject", "topic_key"], "left").join(held, ["user_id", "subject", "topic_key"], "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("attempt_count", "lapse_count", "due_count", "overdue_count")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("avg_quality", "recent_trend")}
    return mastery_score(rows.withColumns(zero))


def held_counts(now: Column) -> list[Column]:
    """Aggregates of a topic's review states."""
    return [F.sum(F.greatest("lapses", F.lit(0))).alias("lapse_count"), F.count_if(F.col("due_at") <= now).alias("due_count"), F.count_if(F.to_date("due_at") < F.to_date(now)).alias("overdue_count")]


def mastery_score(rows: DataFrame) -> DataFrame:
    """rows(attempt_count, avg_quality, recent_trend, lapse_count, due_count, overdue_count) with lapse_ratio and mastery."""
    ratio = F.least(F.lit(1.0), F.col("lapse_count") / F.greatest(F.lit(1), F.col("attempt_count")))
    trend = clamp((F.col("recent_trend") / 2 + 1) * 10, 0.0, 20.0)
    penalty = F.least(F.lit(30.0), 6.0 * F.col("overdue_count"))
    return rows.withColumn("lapse_ratio", ratio).withColumn("mastery", clamp(60 * F.col("avg_quality") / 5 + 20 * (1 - F.col("lapse_ratio")) + trend - penalty))


def swot(rows: DataFrame) -> DataFrame:
    """mastery rows -> strength, weakness, opportunity and threat, and the greatest of them (the first on ties)."""
    m, due, over, n = F.col("mastery"), F.col("due_count"), F.col("overdue_count"), F.col("attempt_count")
    rows = rows.withColumns(
        {
            "strength": clamp(m * (1 - 0.4 * F.least(F.lit(1.0), over / F.greatest(F.lit(1), due + 1)))),
            "weakness": clamp(0.65 * (100 - m) + 35 * F.col("lapse_ratio")),
            "opportunity": clamp(60 * (1 - F.least(F.lit(1.0), n / 6)) + 0.4 * F.greatest(F.lit(0.0), 70 - m)),
            "threat": clamp(F.least(F.lit(70.0), 14.0 * over) + 12 * F.greatest(F.lit(0.0), -F.col("recent_trend"))),
        }
    )
    names = ("strength", "weakness", "opportunity", "threat")
    most = F.greatest(*names)
    return rows.withColumn("bucket", first_of(*((F.col(c) == most, F.lit(c)) for c in names)))


def priority(mastery_score: Column, bucket: Column) -> Column:
    bonus = first_of(*((bucket == b, F.lit(x)) for b, x in (("weakness", 28.0), ("threat", 22.0), ("opportunity", 14.0), ("strength", 4.0))), otherwise=F.lit(12.0))
    return F.greatest(F.lit(0.0), 100 - mastery_score) + bonus


def served_variants(cards: DataFrame, attempts: DataFrame, recent: int = 30) -> DataFrame:
    """For each user and canonical card with variants: the variant to serve, unseen ones first, then the least recent."""
    variants = cards.filter("variant_of_card_id is not null").select(F.col("variant_of_card_id").alias("canonical"), F.col("id").alias("variant"))
    users = attempts.withColumn("canonical", F.col("card_id")).select("user_id", "canonical").distinct()
    last = attempts.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("attempted_at"), F.desc("id")))).filter(F.col("r") <= recent)
    seen = last.groupBy("user_id", F.col("card_id").alias("variant")).agg(F.max("attempted_at").alias("seen_at"))
    rows = users.join(variants, "canonical").join(seen, ["user_id", "variant"], "left")
    order = Window.partitionBy("user_id", "canonical").orderBy(F.col("seen_at").asc_nulls_first(), "variant")
    return rows.withColumn("r", F.row_number().over(order)).filter("r = 1").select("user_id", "canonical", "variant", F.col("seen_at").isNull().alias("unseen"))


def normalised_scope(values: Column) -> Column:
    """Trimmed and folded names of a scope; blank and null ones go."""
    return F.filter(F.transform(values, lambda x: F.lower(F.trim(x))), lambda x: x != "")


def path_ranks(steps: DataFrame, session: str, order: str, topic: str) -> DataFrame:
    """steps of sessions -> (session, topic, path_rank): a topic's place from 0 in the session's path; of several the last."""
    placed = steps.withColumn("_at", F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1)
    return placed.groupBy(session, topic).agg(F.max("_at").alias("path_rank"))
