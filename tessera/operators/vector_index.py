"""An inverted-file index for vectors: rows lie in lists around centroids, and a search looks into the lists nearest to a query.

Centroids come from spherical k-means over a bounded sample of the rows; every row is indexed. Lists are partitions of the
files, so a search reads the lists that it probes and no others; scores of what it reads are exact. Inserts and removals are
batches of their own, without new training: a batch that is written again replaces itself, and of a row's versions the last counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import ranked

#: Rows that k-means sees at most, of the smallest hashes of their ids.
SAMPLE = 65_536
LISTS, ROUNDS, PROBES = 100, 8, 60
#: Rows of a list that lie in one cell at most, about; a cell is held by the task that searches it.
CELL_ROWS = 16_384
QUERY_BLOCK = 256

_ROWS = "id long, v array<double>, version long, cell int, list int"


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Rows of unit length. Components that are null and rows of another width than the centroids' are zero."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    out, sizes = np.zeros((len(col), width)), np.diff(col.offsets.to_numpy())
    flat = np.nan_to_num(np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    right = sizes == width
    out[right] = flat[np.repeat(right, sizes)].reshape(-1, width)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def centroids(rows: DataFrame, lists: int = LISTS, rounds: int = ROUNDS, sample: int = SAMPLE) -> np.ndarray:
    """rows(id, v) -> a row of unit length for each list, or fewer if there are fewer rows. A round sends k sums a task."""
    n = rows.count()
    near = rows.filter("v is not null and size(v) > 0").withColumn("_h", F.xxhash64("id"))
    if n > sample:  # a share of the hash's range, with some to spare for uneven hashes
        near = near.filter(F.col("_h") < int((min(1.0, 1.05 * sample / n) * 2 - 1) * (1 << 63)))
    seeds = near.orderBy("_h", "id").limit(lists).select(F.col("v").cast("array<double>").alias("v")).collect()
    if not seeds:
        return np.zeros((0, 0))
    width = len(seeds[0].v)
    found = np.unique(_matrix(pa.array([r.v for r in seeds], pa.list_(pa.float64())), width), axis=0)

    for _ in range(rounds):
        now = found

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(now)
            for b in batches:
                x = _matrix(b.column(0), width)
                np.add.at(total, (x @ now.T).argmax(1), x)
            has = np.flatnonzero(np.abs(total).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(list(total[has]), pa.list_(pa.float64()))], names=["list", "total"])

        found = now.copy()
        parts = near.select("v").mapInArrow(sums, "list int, total array<double>").select("list", F.posexplode("total").alias("at", "x")).groupBy("list", "at").agg(F.sum("x").alias("x"))
        for r in parts.orderBy("list", "at").collect():
            found[r.list, r.at] = r.x
        norms = np.linalg.norm(found, axis=1, keepdims=True)
        found = np.divide(found, norms, out=now.copy(), where=norms > 0)
    return found


class VectorIndex:
    """An index below a shared folder: centroids, rows by batch and list, and what was removed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        rows = spark.read.schema("list int, v array<double>").parquet(f"{folder}/centroids").orderBy("list").collect()
        self.centroids = np.array([r.v for r in rows]) if rows else np.zeros((0, 0))

    @classmethod
    def build(cls, rows: DataFrame, folder: str, lists: int = LISTS, rounds: int = ROUNDS, sample: int = SAMPLE) -> VectorIndex:
        """rows(id, v): rows without a vector, or with one of another width, are in no list."""
        spark, found = rows.sparkSession, centroids(rows, lists, rounds, sample)
        spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(found)], "list int, v array<double>").coalesce(1).write.parquet(f"{folder}/centroids")
        spark.createDataFrame([], "id long, version long").write.parquet(f"{folder}/removed")
        index = cls(spark, folder)
        index.insert(rows, 0)
        return index

    def _nearest(self, df: DataFrame, vector: str, n: int) -> DataFrame:
        """df with `list`: a row for each of the n nearest centroids."""
        found, at = self.centroids, df.columns.index(vector)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(at), found.shape[1])
                near = np.argsort(-(x @ found.T), axis=1, kind="stable")[:, :n]
                whole = np.flatnonzero(np.abs(x).sum(1))
                which = pa.array(np.repeat(whole, near.shape[1]))
                yield pa.RecordBatch.from_arrays([*(c.take(which) for c in b.columns), pa.array(near[whole].ravel().astype(np.int32))], names=[*b.schema.names, "list"])

        if not len(found):
            return df.limit(0).withColumn("list", F.lit(0))
        return df.mapInArrow(run, df.withColumn("list", F.lit(0)).schema)

    def insert(self, rows: DataFrame, batch: int) -> None:
        """Adds rows(id, v) under the number of the batch; ids that are there already are replaced from this batch on. Rows that repeat an id must be equal."""
        listed = self._nearest(rows.filter("v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")), "v", 1)
        cells = 1 + rows.count() // (CELL_ROWS * max(1, len(self.centroids)) // 4)  # lists are uneven: room for those of four times the mean
        listed = listed.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int"))
        listed.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{self.folder}/rows/version={batch}")
        if batch:
            self.remove(rows, batch)

    def remove(self, ids: DataFrame, batch: int) -> None:
        """Versions of ids(id) from before this batch no longer count."""
        ids.select(F.col("id").cast("long").alias("id"), F.lit(batch).cast("long").alias("version")).distinct().write.mode("overwrite").parquet(f"{self.folder}/removed/batch={batch}")

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """(list, cell, id, v) that count at present; lists: of these partitions alone."""
        found = self.spark.read.schema(_ROWS).option("basePath", f"{self.folder}/rows").parquet(f"{self.folder}/rows")
        found = found if lists is None else found.filter(F.col("list").isin(lists))
        gone = self.spark.read.schema("id long, version long").option("recursiveFileLookup", "true").parquet(f"{self.folder}/removed").groupBy(F.col("id").alias("_id")).agg(F.max("version").alias("_version"))
        return found.join(gone, (F.col("id") == F.col("_id")) & (F.col("version") < F.col("_version")), "left_anti").select("list", "cell", "id", "v")

    def search(self, queries: DataFrame, k: int = 5, probes: int = PROBES) -> DataFrame:
        """queries(query_id, q) -> (query_id, rank, id, score): the k rows of highest cosine in the `probes` lists nearest to each query. With all lists the result is exact.

        Queries go to the cells of their lists; a cell's rows are held, and its queries stream past in blocks."""
        asked = self._nearest(queries.filter("q is not null").select("query_id", F.col("q").cast("array<double>").alias("q")), "q", probes)
        lists = [r.list for r in asked.select("list").distinct().collect()]  # as many as there are lists at most
        rows = self.rows(lists)
        cells = rows.select("list", "cell").distinct()
        every = rows.select("list", "cell", F.lit(0).alias("role"), "id", "v").unionByName(asked.join(cells, "list").select("list", "cell", F.lit(1).alias("role"), F.col("query_id").cast("long").alias("id"), F.col("q").alias("v")))
        width = self.centroids.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, ids, blocks, held, waiting = None, [], [], None, []

            def answered() -> pa.RecordBatch:
                own, x = np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])
                all_ids, y = held
                score = x @ y.T
                take = min(k, score.shape[1])
                top = np.argpartition(-score, take - 1, axis=1)[:, :take]
                least = np.take_along_axis(score, top, 1).min(1) - 1e-6  # ties of rounded scores are settled behind
                q, r = np.nonzero(score >= least[:, None])
                waiting.clear()
                return pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(all_ids[r]), pa.array(score[q, r])], names=["query_id", "id", "score"])

            for b in batches:
                key = b.column(0).to_numpy().astype(np.int64) * (1 << 32) + b.column(1).to_numpy()
                role, vectors = b.column(2).to_numpy(), _matrix(b.column(4), width)
                edges = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (role[1:] != role[:-1])))
                for s, e in zip(edges, np.append(edges[1:], len(key)), strict=True):
                    if key[s] != at:
                        if waiting and held:
                            yield answered()
                        at, ids, blocks, held = key[s], [], [], None
                        waiting.clear()
                    own = b.column(3).slice(s, e - s).to_numpy(), vectors[s:e]
                    if role[s] == 0:
                        ids.append(own[0])
                        blocks.append(own[1])
                        continue
                    if held is None and ids:
                        held = np.concatenate(ids), np.concatenate(blocks)
                    for c in range(0, e - s, QUERY_BLOCK):
                        waiting.append((own[0][c : c + QUERY_BLOCK], own[1][c : c + QUERY_BLOCK]))
                        if held and sum(len(w[0]) for w in waiting) >= QUERY_BLOCK:
                            yield answered()
            if waiting and held:
                yield answered()

        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        hits = every.repartition(parts, "list", "cell").sortWithinPartitions("list", "cell", "role").mapInArrow(run, "query_id long, id long, score double")
        return ranked(hits.select("query_id", "id", F.round("score", 6).alias("score")), k).select("query_id", "rank", "id", "score")
