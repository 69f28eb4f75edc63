"""A keyed table that is changed in place of being rewritten: rows lie in buckets of their keys, and a merge writes the buckets that it touches.

Files are never overwritten. A merge has a number; it reads the table as it was before that number, writes new files for its
buckets, and commits a small manifest that says where each bucket lies. A merge that fails leaves the table as it was, one that is
run again ends in the same rows, and files of buckets that nothing touches stay as they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class BucketTable:
    """folder: in a shared store. keys: columns that name a row. by: those that name its bucket, the keys by default."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | str, keys: list[str], by: list[str] | None = None, buckets: int = BUCKETS):
        self.spark, self.folder, self.keys, self.by, self.buckets = spark, folder, keys, by or keys, buckets
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _files(self, name: str):
        """(file system, path) of a name below the folder, for the driver's own small files."""
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(sc._jsc.hadoopConfiguration()), path

    def _names(self, name: str) -> list[str]:
        files, path = self._files(name)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def _manifest(self, before: int | None = None) -> dict[int, str]:
        """Which folder holds each bucket, by the last manifest, or the last of those under `before`."""
        done = [tuple(map(int, n.split(".")[:2])) for n in self._names("manifest") if n.endswith(".json")]
        done = [n for n in done if before is None or n[0] < before]
        if not done:
            return {}
        files, path = self._files("manifest/{}.{}.json".format(*max(done)))
        stream = files.open(path)
        try:
            return {int(b): v for b, v in json.loads(bytes(stream.readAllBytes()))}
        finally:
            stream.close()

    def _commit(self, number: int, where: dict[int, str]) -> None:
        """A manifest gets its name when it is whole; a number that is merged again gets a further one."""
        again = 1 + max((int(n.split(".")[1]) for n in self._names("manifest") if n.endswith(".json") and int(n.split(".")[0]) == number), default=0)
        files, path = self._files(f"manifest/{number}.{again}.json")
        _, half = self._files(f"manifest/{number}.{uuid.uuid4().hex}")
        stream = files.create(half)
        stream.write(bytearray(json.dumps(sorted(where.items())).encode()))
        stream.close()
        if not files.rename(half, path):
            raise OSError(f"manifest {number} of {self.folder} was not written")

    def _read(self, where: dict[int, str]) -> DataFrame:
        if not where:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/data/{v}/bucket={b}" for b, v in sorted(where.items())))

    def read(self, of: DataFrame | None = None) -> DataFrame:
        """The rows; of: only those of the buckets in which these rows' keys lie."""
        where = self._manifest()
        return self._read(where if of is None else {b: where[b] for b in self.touched(of) if b in where})

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows, of which there are self.buckets at most."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def merge(self, number: int, changes: DataFrame, combine: Callable[[DataFrame], DataFrame]) -> None:
        """combine(old) -> the rows of the buckets in which the keys of `changes` lie, from what these buckets held before merge `number`. Numbers count up; the last may be merged again."""
        before, label = self._manifest(number), f"{number}-{uuid.uuid4().hex[:12]}"
        touched = self.touched(changes)
        old = self._read({b: before[b] for b in touched if b in before})
        rows = combine(old).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).withColumn("bucket", self.bucket())
        # a bucket has one file, and more only where it is large
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/data/{label}")
        written = {int(n.removeprefix("bucket=")) for n in self._names(f"data/{label}") if n.startswith("bucket=")}
        self._commit(number, {b: v for b, v in before.items() if b not in touched} | dict.fromkeys(written, label))

    def upsert(self, number: int, rows: DataFrame, keep: tuple[str, ...] = ()) -> None:
        """rows, one for each key, in place of those of equal keys; columns in keep stay as they were where a row existed."""
        from ..operators.merge import upserted

        self.merge(number, rows, lambda old: upserted(old, rows, self.keys, keep))

    def delete(self, number: int, keys: DataFrame) -> None:
        gone = keys.select(*(F.col(k).alias(f"_{k}") for k in self.keys)).distinct()
        self.merge(number, keys, lambda old: old.join(gone, reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys)), "left_anti"))
