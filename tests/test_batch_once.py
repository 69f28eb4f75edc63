"""A batch of attempts is worked out once for all that a refresh does with it."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators.mastery import MasteryStore


def test_a_batch_is_read_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(q):
        seen.add(1)
        return q

    rows = [(k, k % 3, k % 5, dt.datetime(2025, 1, 1) + dt.timedelta(hours=k), k % 6) for k in range(40)]
    tried = spark.createDataFrame(rows, "id long, user_id long, card_id long, attempted_at timestamp, quality int").withColumn("quality", counted("quality"))
    cards = spark.range(5).select(F.col("id").alias("card_id"), F.lit("os").alias("subject"), F.lit("os:core").alias("topic_key"))
    store = MasteryStore(spark, f"file://{tmp_path}/m", buckets=2)
    store.refresh(0, tried, cards, F.lit("2025-02-01").cast("timestamp"))
    assert seen.value == 40
    assert {(r.user_id, r.attempt_count) for r in store.topics.read().collect()} == {(0, 14), (1, 13), (2, 13)}
