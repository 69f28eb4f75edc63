"""Mastery kept up to date: attempts come in batches, and a batch is merged into what is known of the users that it names.

Two bucket tables by user: review states by card, and topics, each with partial sums of its attempts (count, sum of qualities, the
last three), which merge, and with its scores. A batch folds its attempts onto the states that are there, adds its partial sums,
and scores the topics of its users again. Users that a batch does not name are not read beyond their bucket, and no user is paired
with topics that they have not tried. A batch that is run again ends in the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.buckets import BucketTable
from ..sources.shared import written
from . import reviews as R

_LAST = "array<struct<attempted_at:{t},id:bigint,quality:int>>"
_SCORES = ("mastery", "strength", "weakness", "opportunity", "threat")


class MasteryStore:
    """time: the type of attempted_at. Attempts of a batch must not lie before those of earlier batches of the same user and card."""

    def __init__(self, spark: SparkSession, folder: str, time: str = "timestamp", buckets: int = 32):
        topic = "user_id bigint, subject string, topic_key string"
        self.time = time
        self.states = BucketTable(spark, f"{folder}/states", f"user_id bigint, card_id bigint, repetitions int, interval_days int, ease_factor double, lapses int, last_reviewed_at {time}, due_at {time}, reviews bigint", ["user_id", "card_id"], ["user_id"], buckets)
        counts = "attempt_count bigint, total bigint, last {last}, lapse_count bigint, due_count bigint, overdue_count bigint".replace("{last}", _LAST.format(t=time))
        self.topics = BucketTable(spark, f"{folder}/topics", f"{topic}, {counts}, {', '.join(f'{s} double' for s in _SCORES)}, bucket_name string, created int, updated int", ["user_id", "subject", "topic_key"], ["user_id"], buckets)

    def refresh(self, number: int, attempts: DataFrame, identities: DataFrame, now: Column) -> None:
        """attempts(id, user_id, card_id, attempted_at, quality) of batch `number`; identities(card_id, subject, topic_key)."""
        attempts = written(attempts.select("id", "user_id", "card_id", "attempted_at", "quality"))  # both merges read them several times
        self.states.merge(number, attempts, lambda old: _folded(old, attempts))
        users = written(attempts.select("user_id").distinct())
        held = self.states.read(attempts).join(users, "user_id", "left_semi").join(identities, "card_id").groupBy("user_id", "subject", "topic_key").agg(*R.held_counts(now))
        self.topics.merge(number, attempts, lambda old: self._scored(number, old, attempts.join(identities, "card_id"), users, held))

    def _scored(self, number: int, old: DataFrame, tried: DataFrame, users: DataFrame, held: DataFrame) -> DataFrame:
        keys = ["user_id", "subject", "topic_key"]
        order = Window.partitionBy(*keys).orderBy(F.desc("attempted_at"), F.desc("id"))
        ranked = tried.withColumn("_r", F.row_number().over(order))
        last = F.collect_list(F.when(F.col("_r") <= 3, F.struct("attempted_at", F.col("id").cast("bigint").alias("id"), F.col("quality").cast("int").alias("quality"))))  # three at most
        new = ranked.groupBy(*keys).agg(F.count("*").alias("attempt_count"), F.sum("quality").alias("total"), last.cast(_LAST.format(t=self.time)).alias("last"))
        partial = old.select(*keys, "attempt_count", "total", "last", "created").unionByName(new.withColumn("created", F.lit(number)))
        merged = partial.join(users, "user_id", "left_semi").groupBy(*keys).agg(
            F.sum("attempt_count").alias("attempt_count"), F.sum("total").alias("total"), F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("last")))), 1, 3).alias("last"), F.min("created").alias("created")
        )
        recent = F.aggregate("last", F.lit(0).cast("bigint"), lambda s, a: s + a["quality"]) / F.size("last")
        rows = merged.join(held, keys, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("lapse_count", "due_count", "overdue_count")})
        rows = rows.withColumn("avg_quality", F.col("total") / F.col("attempt_count")).withColumn("recent_trend", recent - F.col("avg_quality"))
        scored = R.swot(R.mastery_score(rows)).withColumn("bucket_name", F.col("bucket")).withColumn("updated", F.lit(number))
        columns = self.topics.schema.names
        return scored.select(*columns).unionByName(old.join(users, "user_id", "left_anti").select(*columns))


def _folded(old: DataFrame, attempts: DataFrame) -> DataFrame:
    """The states after the batch: its reviews, in order of time and id, onto the state that is there."""
    new = attempts.groupBy("user_id", "card_id").agg(F.array_sort(F.collect_list(F.struct("attempted_at", "id", "quality"))).alias("h"), F.max("attempted_at").alias("_last"), F.count("*").alias("_n"))
    both = old.join(new, ["user_id", "card_id"], "full")
    start = F.struct(F.coalesce("repetitions", F.lit(0)), F.coalesce("interval_days", F.lit(0)), F.coalesce("ease_factor", F.lit(2.5)), F.coalesce("lapses", F.lit(0))).cast(R.STATE)
    folded = both.withColumn("s", F.aggregate(F.coalesce("h", F.array().cast(both.schema["h"].dataType)), start, lambda s, a: R.next_state(s, a["quality"])))
    last = F.coalesce(F.greatest("_last", "last_reviewed_at"), "_last", "last_reviewed_at")
    return folded.select("user_id", "card_id", "s.*", last.alias("last_reviewed_at"), (last + F.make_dt_interval(days=F.col("s.interval_days"))).alias("due_at"), (F.coalesce("reviews", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("reviews"))
