"""Vector code compression: a codebook for each part of the vectors, and for each vector the indexes of its parts' nearest entries.

The nearest entry is found exactly. Bounds from coarse to fine come first: a part is cut into segments, and of two vectors'
segments the squared distance is at least length x (difference of means)^2 + (difference of residual norms)^2. Level one has
one segment, level two segments of four components, level three of two. An entry whose bound lies above the exact distance of the best entry
seen so far is filtered out, with room for rounding; what survives all levels gets exact integer distances.

A round sends one row a task for each entry and component, so no group of vectors is moved; codebooks are of fixed size and go
to the tasks with the code. The table is read once for its width, once for the seeds, once a round and once for the codes.

Nulls and edge cases: vectors that are null or hold null or non-finite components take no part; vectors shorter than the
longest count as filled with zeros, and all are filled to a multiple of the parts; rows that repeat an id are coded each by
itself, and seeds go by id, null ids last, then by vector; with fewer rows than entries the codebook has as many entries as rows;
equal entries stay, and the lower index gets all. Components of 2^63 and above behind the scale, and errors that a long cannot hold,
raise an error. Other columns than those asked for are not read. An empty table gives an empty result and empty codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, small_batches

ROWS_AT_ONCE = 1024
#: Rows after which a task hands its sums on; with it sums of components below 2^42 fit in a long.
ROWS_A_SUM = 1 << 20
#: Components of a segment by level; 0: the whole part.
SEGMENTS = (0, 4, 2)
#: Room for rounding, as a share of the squared norms.
ROOM = 1e-9


def valid(vector: Column) -> Column:
    inf = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < inf))


def integers(col: pa.Array, scale: float, width: int) -> np.ndarray:
    """floor(scale * x) of a list column, a row for each vector, filled with zeros to width."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = np.diff(col.offsets.to_numpy())
    flat = np.floor(np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64) * scale)
    if len(flat) and np.abs(flat).max() >= 2.0**63:
        raise OverflowError("a component is too large for a long")
    out = np.zeros((len(col), width), np.int64)
    out[np.repeat(np.arange(len(col)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.astype(np.int64)
    return out


def _fits(*blocks: np.ndarray) -> bool:
    """Whether squared distances between rows of these stay within a long."""
    most = max((max(int(b.max(initial=0)), -int(b.min(initial=0))) for b in blocks), default=0)
    return 4 * most * most * max(b.shape[1] for b in blocks) < 1 << 62


def segments(rows: np.ndarray, size: int) -> np.ndarray:
    """Each row's means (times the root of the length) and residual norms by segment: the squared distance of two such rows bounds that of the rows from below."""
    n, width = rows.shape
    if not width:
        return np.zeros((n, 0))
    cuts = np.arange(0, width, size or width)
    sizes = np.diff(np.append(cuts, width))
    x = rows.astype(np.float64)
    means = np.add.reduceat(x, cuts, axis=1) / sizes
    rest = (x - np.repeat(means, sizes, axis=1)) ** 2
    return np.concatenate([means * np.sqrt(sizes), np.sqrt(np.add.reduceat(rest, cuts, axis=1))], axis=1)


def _first_least(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Of pairs that lie by row (each row has one at least): the place of each row's first least value."""
    least = np.minimum.reduceat(values, np.searchsorted(row, np.arange(n)))
    at = np.flatnonzero(values == least[row])
    return at[np.append(True, np.diff(row[at]) > 0)]


class Book:
    """The entries of one part."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.levels = [segments(entries, s) for s in SEGMENTS]
        self.square = (entries.astype(np.float64) ** 2).sum(1)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and exact squared distance of each row's nearest entry (ties: the lower index), and how many exact distances were taken."""
        kind = np.int64 if _fits(rows, self.entries) else object
        own, entries = rows.astype(kind), self.entries.astype(kind)

        def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            apart = own[i] - entries[j]
            return (apart * apart).sum(1) if kind is object else np.einsum("ij,ij->i", apart, apart)

        n, every = len(rows), np.arange(len(rows))
        square = (rows.astype(np.float64) ** 2).sum(1)
        room = ROOM * (square[:, None] + self.square)
        best, open_ = np.full(n, np.inf), np.ones((n, len(self.entries)), bool)
        for size, level in zip(SEGMENTS, self.levels, strict=True):
            mine = segments(rows, size)
            if np.count_nonzero(open_) * 16 < open_.size:  # few are left: each by itself
                i, j = np.nonzero(open_)
                bound = ((mine[i] - level[j]) ** 2).sum(1) - room[i, j]
                at = _first_least(bound, i, n)
                best = np.minimum(best, exact(i[at], j[at]).astype(np.float64))
                open_[i, j] = bound <= best[i] * (1 + ROOM)
                continue
            bound = mine @ level.T
            bound *= -2
            bound += (mine * mine).sum(1)[:, None] + (level * level).sum(1)
            bound -= room
            best = np.minimum(best, exact(every, np.where(open_, bound, np.inf).argmin(1)).astype(np.float64))
            open_ &= bound <= (best * (1 + ROOM))[:, None]
        i, j = np.nonzero(open_)
        far = exact(i, j)
        at = _first_least(far, i, n)
        return j[at], far[at], len(i)


class Codebooks:
    """parts books of entries; scale and width tell how vectors become rows of integers."""

    def __init__(self, books: list[np.ndarray], scale: float, width: int):
        self.books, self.scale, self.width = [Book(b) for b in books], scale, width

    @property
    def entries(self) -> list[np.ndarray]:
        return [b.entries for b in self.books]

    def parts(self, rows: np.ndarray) -> list[np.ndarray]:
        return np.split(rows, len(self.books), axis=1)

    def sha256(self) -> str:
        """Of all entries' components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for b in self.entries for x in b.ravel().tolist()).encode()).hexdigest()


def _blocks(batches: Iterator[pa.RecordBatch], books: Codebooks, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(k, ROWS_AT_ONCE)
            yield part, integers(part.column(at), books.scale, books.width)
    give_back()


def _sums(vectors: DataFrame, vector_col: str, books: Codebooks) -> DataFrame:
    """(slot, at, high, low): sums of the components of the rows whose nearest entry is `slot`, as high * 2^32 + low; at -1: their number."""
    schema = "slot int, at int, high long, low long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = len(books.entries[0]), books.width // len(books.books)
        slots = k * len(books.books)
        seen, count, total = 0, np.zeros(slots, np.int64), np.zeros((slots, width), np.int64)

        def handed() -> pa.RecordBatch:
            has = np.flatnonzero(count)
            all_ = np.concatenate([count[has, None], total[has]], axis=1)
            low = all_ & 0xFFFFFFFF
            slot, at = np.repeat(has, width + 1), np.tile(np.arange(-1, width), len(has))
            return pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(((all_ - low) >> 32).ravel().astype(np.int64)), pa.array(low.ravel().astype(np.int64))], names=["slot", "at", "high", "low"])

        for _, rows in _blocks(batches, books, 0):
            if rows.size and int(np.abs(rows.astype(np.float64)).max()) >= 1 << 42 and total.dtype != object:
                total = total.astype(object)
            for p, part in enumerate(books.parts(rows)):
                near, _, _ = books.books[p].nearest(part)
                np.add.at(total, p * k + near, part.astype(total.dtype))
                count += np.bincount(p * k + near, minlength=slots)
            seen += len(rows)
            if seen >= ROWS_A_SUM:
                yield handed()
                seen, count, total = 0, np.zeros_like(count), np.zeros_like(total)
        if seen:
            yield handed()

    return vectors.select(vector_col).mapInArrow(run, schema).groupBy("slot", "at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks:
    """Codebooks that start as the parts of the rows of smallest ids; each round replaces an entry by the floored mean of the parts nearest to it."""
    small_batches(vectors.sparkSession)
    rows = vectors.filter(valid(F.col(vector_col))).select(id_col, vector_col)
    longest = rows.agg(F.max(F.size(vector_col))).first()[0] or 0
    width = -(-longest // parts) * parts
    seeds = [r[0] for r in rows.orderBy(F.col(id_col).asc_nulls_last(), vector_col).limit(entries).select(vector_col).collect()]
    first = integers(pa.array(seeds, pa.list_(pa.float64())), scale, width)
    books = Codebooks(np.split(first, parts, axis=1), scale, width)
    for _ in range(rounds if seeds else 0):
        k, found = len(seeds), {}
        for slot, at, high, low in _sums(rows, vector_col, books).collect():  # entries x (components + 1) rows
            found.setdefault(slot, {})[at] = (high << 32) + low
        new = [b.copy() for b in books.entries]
        for slot, sums in found.items():
            n = sums.pop(-1)
            new[slot // k][slot % k] = [sums[i] // n for i in range(width // parts)]
        books = Codebooks(new, scale, width)
    return books


def encode(vectors: DataFrame, books: Codebooks, keep: list[str] | None = None, vector_col: str = "embedding") -> DataFrame:
    """The columns in keep (all by default), code (array of an index for each part) and error: the squared distance to the entries that the code names."""
    small_batches(vectors.sparkSession)
    keep = [c for c in (vectors.columns if keep is None else keep) if c not in ("code", "error")]  # columns of these names are replaced
    schema = T.StructType([*(vectors.schema[c] for c in keep), T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    columns = list(dict.fromkeys([*keep, vector_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _blocks(batches, books, columns.index(vector_col)):
            found = [b.nearest(p) for b, p in zip(books.books, books.parts(rows), strict=True)]
            code = np.stack([x[0] for x in found], axis=1).astype(np.int32)
            error = [sum(int(e) for e in x) for x in zip(*(f[1].tolist() for f in found), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, code.shape[1], dtype=np.int32)), pa.array(code.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in keep), lists, pa.array(error, pa.int64())], names=schema.names)

    return vectors.filter(valid(F.col(vector_col))).select(*columns).mapInArrow(run, schema)
