"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are dealt into cells of bounded size. A cell turns its rows into postings: for each term (vector position) the rows
that have a weight there. The query rows stream past every cell in blocks; for each term, the queries that hold it scatter
weight x posting weight into dense score arrays, one score for each row of the cell. Each cell keeps the k best per query by
partition selection, and the cells' lists are merged by score. Nothing is pruned, so scores and ranks are exact.

Nulls and edge cases: vectors that are null or hold null or non-finite components take no part, nor do null ids; an empty
vector takes part with score 0; vectors of different lengths are compared over the positions that both have; rows that repeat
an id count once, by the smallest vector; ties go to the smaller id; components of 2^63 and above behind the scale, and scores in the
result that a long cannot hold, raise an error, since no long stands for them; where products could exceed a long on the way, whole
numbers of any size are summed. Other columns are not read. Empty tables or no queries give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL_ROWS = 16384
LEAST_ROWS = 2048  # smaller cells are not made for the sake of parallel work
QUERY_BLOCK = 64


def _largest(x: np.ndarray) -> int:
    """The greatest magnitude, also of the least long."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


class Postings:
    """The rows of a cell by term. ids ascend; weights are integers."""

    def __init__(self, ids: np.ndarray, flat: np.ndarray, lengths: np.ndarray):
        self.ids = ids
        row = np.repeat(np.arange(len(ids)), lengths)
        term = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        has = flat != 0
        row, term, weight = row[has], term[has], flat[has]
        order = np.argsort(term, kind="stable")
        terms, first = np.unique(term[order], return_index=True)
        cuts = np.append(first, len(order))
        self.lists = {int(t): (row[order[a:b]], weight[order[a:b]]) for t, a, b in zip(terms, cuts, cuts[1:], strict=False)}
        self.most, self.width = _largest(flat), int(lengths.max(initial=0))

    def scores(self, queries: list[np.ndarray]) -> np.ndarray:
        """A dense row of scores for each query, one term at a time; Python's integers where longs may not do."""
        width = max((len(q) for q in queries), default=0)
        block = np.zeros((len(queries), width), np.int64)
        for i, q in enumerate(queries):
            block[i, : len(q)] = q
        kind = np.int64 if _largest(block) * self.most * min(width, self.width) < 1 << 63 else object
        block, out = block.astype(kind), np.zeros((len(queries), len(self.ids)), kind)
        for t in range(width):
            if t not in self.lists:
                continue
            rows, weights = self.lists[t]
            who = np.flatnonzero(block[:, t])
            if not len(who):
                continue
            weights = weights.astype(kind)
            if len(rows) == len(self.ids) and len(who) == len(queries):
                out += block[:, t, None] * weights
            else:
                out[who[:, None], rows] += block[who, t, None] * weights
        return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller position; in no order."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, -k)[-k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v array<long>): floor(scale * x) of each component of the valid vectors."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    small = F.forall(x, lambda c: F.abs(c.cast("double") * scale) < F.lit(float(1 << 63)))
    v = F.when(small, F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))).otherwise(F.raise_error(F.lit("a component is too large for a long")))
    return vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), v.cast("array<long>").alias("v"))


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(query_id, rank, id, score): for each row under is_query, the k other rows of highest inner product."""
    rows = quantized(vectors, id_col, vector_col, scale)
    asked = quantized(vectors.filter(is_query), id_col, vector_col, scale)
    n = vectors.count()
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = max(1, -(-n // cell_rows), min(parts, n // LEAST_ROWS))  # each cell is a partition of its own
    own = rows.select(F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int").alias("cell"), F.lit(1).alias("role"), "id", "v")
    past = asked.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(2).alias("role"), "id", "v")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "id", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, lists, postings = None, [], [], None
        waiting: list[tuple[int, np.ndarray]] = []

        def answered() -> pa.RecordBatch:
            scores = postings.scores([q for _, q in waiting])
            out: list[list] = [[], [], []]
            for (query, _), own in zip(waiting, scores, strict=True):
                me = np.searchsorted(postings.ids, query)
                if me < len(postings.ids) and postings.ids[me] == query:
                    keep = np.delete(np.arange(len(own)), me)
                    at = keep[best(own[keep], k)]
                else:
                    at = best(own, k)
                out[0] += [query] * len(at)
                out[1] += postings.ids[at].tolist()
                out[2] += own[at].tolist()
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=schema.names)

        asked_last = None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            for at in range(batch.num_rows):
                c, role, i = int(columns[0][at]), int(columns[1][at]), int(columns[2][at])
                if c != cell:
                    if waiting:
                        yield answered()
                    cell, ids, lists, postings, asked_last = c, [], [], None, None
                if role == 1:
                    if not ids or ids[-1] != i:
                        ids.append(i)
                        lists.append(columns_v(batch, at))
                    continue
                if postings is None:
                    lengths = np.array([len(x) for x in lists], np.int64)
                    postings = Postings(np.array(ids, np.int64), np.concatenate(lists) if lists else np.zeros(0, np.int64), lengths)
                if i != asked_last:
                    waiting.append((i, columns_v(batch, at)))
                    asked_last = i
                if len(waiting) >= QUERY_BLOCK:
                    yield answered()
        if waiting:
            yield answered()

    def columns_v(batch: pa.RecordBatch, at: int) -> np.ndarray:
        col = batch.column(3)
        a, b = col.offsets[at].as_py(), col.offsets[at + 1].as_py()
        return col.values.to_numpy(zero_copy_only=False)[a:b]

    found = own.unionByName(past).repartitionById(cells, "cell").sortWithinPartitions("cell", "role", "id", "v").mapInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
