"""Changes as DataFrames: what an upsert, a sync or a seed would do, and the table that comes of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def differences(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9, delete: bool = False) -> DataFrame:
    """(keys, op): insert, update, unchanged, and delete if asked for. Numbers within tolerance are equal, and so are two nulls."""
    a = old.select(*keys, *(F.col(v).alias(f"old_{v}") for v in values), F.lit(True).alias("in_old"))
    b = new.select(*keys, *(F.col(v).alias(f"new_{v}") for v in values), F.lit(True).alias("in_new"))
    kinds = dict(new.dtypes)

    def same(v: str):
        x, y = F.col(f"old_{v}"), F.col(f"new_{v}")
        return x.eqNullSafe(y) | (F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)) if kinds[v] in ("double", "float") else F.lit(False))

    equal = reduce(lambda p, q: p & q, (same(v) for v in values), F.lit(True))
    rows = a.join(b, keys, "full" if delete else "right")
    op = F.when(F.col("in_old").isNull(), F.lit("insert")).when(F.col("in_new").isNull(), F.lit("delete")).when(equal, F.lit("unchanged")).otherwise(F.lit("update"))
    return rows.select(*keys, op.alias("op"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """old with the rows of new put over those of equal keys, nulls included; columns in `keep` stay as they were where a row existed."""
    columns = [c for c in old.columns if c not in keys]
    a = old.select(*keys, *(F.col(c).alias(f"old_{c}") for c in columns), F.lit(True).alias("in_old"))
    b = new.select(*(F.col(k).alias(f"key_{k}") for k in keys), *(F.col(c).alias(f"new_{c}") for c in columns), F.lit(True).alias("in_new"))
    value = lambda c: F.when(F.col("in_new").isNull() | (F.col("in_old").isNotNull() & F.lit(c in keep)), F.col(f"old_{c}")).otherwise(F.col(f"new_{c}")).alias(c)
    same = reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"key_{k}")) for k in keys))
    return a.join(b, same, "full").select(*(F.when(F.col("in_new").isNull(), F.col(k)).otherwise(F.col(f"key_{k}")).alias(k) for k in keys), *(value(c) for c in columns))


def refreshed_vectors(stored: DataFrame, chunks: DataFrame, model: str) -> DataFrame:
    """stored(id, model, hash, vector), chunks(id, hash) -> rows for all chunks; the vector is null, to be filled, where model or hash is another."""
    rows = chunks.join(stored.select("id", F.col("model").alias("m"), F.col("hash").alias("h"), "vector"), "id", "left")
    valid = F.col("m").eqNullSafe(F.lit(model)) & F.col("h").eqNullSafe(F.col("hash"))
    return rows.select("id", F.lit(model).alias("model"), "hash", F.when(valid, F.col("vector")).alias("vector"))


def seeded(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """rows(ordinal, question, source, complete) with `action`: skip_incomplete, skip_existing (in the table or earlier in the batch; null sources are equal), insert."""
    known = existing.select("question", "source").distinct().withColumn("known", F.lit(True))
    on = rows["question"].eqNullSafe(known["question"]) & rows["source"].eqNullSafe(known["source"])
    found = rows.join(known, on, "left").select(rows["*"], "known")
    first = F.row_number().over(Window.partitionBy("question", "source", "complete").orderBy("ordinal"))
    action = F.when(~F.col("complete"), F.lit("skip_incomplete")).when(F.col("known").isNotNull() | (F.col("n") > 1), F.lit("skip_existing")).otherwise(F.lit("insert"))
    return found.withColumn("n", first).withColumn("action", action).drop("n", "known")


def last_wins(log: DataFrame, key: str, order: str) -> DataFrame:
    """The latest entry for each key of an append-only log."""
    return log.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")
