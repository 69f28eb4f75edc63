"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

Features are counts of hashed words, of hashed 4-grams of character shapes, and of repeated words. Document frequencies
are counted over the whole corpus. The latent space is the truncated SVD of the weighted features of labelled documents:
a sample of at most `max_labelled` rows, chosen by a seeded hash of their ids (a documented bound: it fixes the model's
size, and so what is broadcast). Every document is projected, compared with every labelled vector by exact cosine
products in blocks, and scored by the labels of its nearest neighbours, weighted by similarity.

Nulls and edge cases: a null or empty text has no features and gets the labelled rows' mean label; labels that are
null or whose id is null or unknown are not learnt from, and an id labelled twice counts by its least label; without
labelled rows every score is 0.5; rows that repeat an id are scored row by row; other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SEGMENT, raw, slices, small_batches, window_hashes, word_hashes, words

WORD_DIMS, SHAPE_DIMS, MARKS = 1024, 1024, 4
DIMS = WORD_DIMS + SHAPE_DIMS + MARKS
#: Of one feature in one text, in training and scoring alike.
MOST = 65535

_SHAPE = np.arange(256, dtype=np.uint64)
for _kind, _codes in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (1, range(128, 256)), (4, (9, 32)), (5, (10, 11, 12, 13))):
    _SHAPE[list(_codes)] = _kind


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """texts x DIMS feature counts (float32: exact up to 2^24 of a kind in one text) of a slice of texts."""
    n = len(offsets) - 1
    out = np.zeros((n, DIMS), np.float32)

    def add(at: int, dims: int, text: np.ndarray, feature: np.ndarray) -> None:
        out[:, at : at + dims] = np.bincount(text * dims + feature, minlength=n * dims).reshape(n, dims)

    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    of = np.repeat(np.arange(n), np.diff(first))
    add(0, WORD_DIMS, of, (h % np.uint64(WORD_DIMS)).astype(np.int64))
    for back in (1, 2):
        same = np.flatnonzero((h[back:] == h[:-back]) & (of[back:] == of[:-back])) if len(h) > back else np.zeros(0, np.int64)
        add(WORD_DIMS + SHAPE_DIMS + back - 1, 1, of[same], 0)
    total = np.zeros(n * SHAPE_DIMS, np.int64)
    for at in range(0, len(data), SEGMENT):  # 4-grams of shapes, in runs that overlap by three
        grams = window_hashes(_SHAPE[data[at : at + SEGMENT + 3]], 4)
        text = np.searchsorted(offsets, np.arange(at, at + len(grams) + 3), side="right") - 1
        whole = text[: len(grams)] == text[3:] if len(grams) else np.zeros(0, bool)
        found = text[: len(grams)][whole] * SHAPE_DIMS + (grams[whole] % np.uint64(SHAPE_DIMS)).astype(np.int64)
        total += np.bincount(found, minlength=n * SHAPE_DIMS)
    out[:, WORD_DIMS : WORD_DIMS + SHAPE_DIMS] = total.reshape(n, SHAPE_DIMS)
    return out


@dataclass(frozen=True)
class Model:
    """idf: DIMS; axes: DIMS x dims of the latent space; vectors: unit rows of the labelled documents; labels: 0 or 1."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def weighted(self, found: np.ndarray) -> np.ndarray:
        return weighted(found, self.idf)

    def project(self, found: np.ndarray) -> np.ndarray:
        return unit(self.weighted(found) @ self.axes)

    def vote(self, found: np.ndarray, neighbours: int, block: int = 256) -> np.ndarray:
        out = np.full(len(found), float(self.labels.mean()) if len(self.labels) else 0.5)
        if not len(self.labels):
            return out
        own = self.project(found)
        k = min(neighbours, len(self.labels))
        for at in range(0, len(own), block):
            cosine = own[at : at + block] @ self.vectors.T
            near = np.argpartition(cosine, len(self.labels) - k, axis=1)[:, -k:] if k < len(self.labels) else np.tile(np.arange(k), (len(cosine), 1))
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** 8
            total = weight.sum(axis=1)
            score = (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
            out[at : at + block] = np.where(total > 0, score, out[at : at + block])
        return np.clip(out, 0.0, 1.0)


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length in two parts: words, which weigh 0.3, and shapes and repeats."""
    x = (np.log1p(found) * idf).astype(np.float32)
    lexical, shape = unit(x[:, :WORD_DIMS]), unit(x[:, WORD_DIMS:])
    return np.concatenate([lexical * np.float32(0.3), shape], axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def held_out(id_col: str) -> Column:
    """Rows that are kept for judging: the CRC-32 of the id as text, modulo 3, is 1."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many documents each feature occurs, and the number of documents: summed on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS + 1, np.int64)
        for batch in slices(batches, text_col, 1 << 20, 256):
            found = counts(*raw(batch.column(0)))
            total[:DIMS] += (found > 0).sum(axis=0)
            total[DIMS] += len(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(total)], names=["f", "n"])

    out = np.zeros(DIMS + 1, np.int64)
    for r in docs.select(text_col).mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():
        out[r.f] = r.n
    return out[:DIMS], int(out[DIMS])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 3000, dims: int = 48, seed: int = 17) -> Model:
    """Learns from labels that are not held out. Reads the corpus for document frequencies, and the labelled sample's texts."""
    small_batches(docs.sparkSession)
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.min(label_col).alias("_label"))
    sample = usable.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(max_labelled)
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 1 << 20, 256):
            found = np.minimum(counts(*raw(batch.column(2))), MOST).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())], names=schema.names)

    texts = docs.select(id_col, text_col).join(F.broadcast(sample), id_col).select(id_col, "_label", text_col)
    own = texts.mapInArrow(run, schema).groupBy("id").agg(F.min(F.struct("label", "x")).alias("r"))  # one row for each id: the sample bounds it
    rows = {r.id: r.r for r in own.collect()}
    frequency, n = document_frequencies(docs, text_col)
    idf = np.log((1 + n) / (1 + frequency)).astype(np.float32) + np.float32(0.1)
    rows = [rows[k] for k in sorted(rows)]
    if not rows:
        return Model(idf, np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    x = weighted(np.stack([np.frombuffer(r.x, np.uint16) for r in rows]).astype(np.float32), idf)
    values, axes = np.linalg.eigh((x.T @ x).astype(np.float64))  # right singular vectors of x
    axes = np.ascontiguousarray(axes[:, ::-1][:, :dims]).astype(np.float32)
    return Model(idf, axes, unit(x @ axes), np.array([r.label for r in rows], np.float64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", neighbours: int = 15, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (id by default), score double and predicted int: 1 if score >= 0.5, else 0."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [id_col] if keep is None else keep
    columns = list(dict.fromkeys([*keep, text_col]))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 1 << 20, 256):
            found = shared.value.vote(np.minimum(counts(*raw(batch.column(columns.index(text_col)))), MOST), neighbours)
            yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in keep), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select(*columns).mapInArrow(run, schema)


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that the classifier rejects. A column of docs may be called score or predicted."""
    plain = docs.select(*(F.col(c).alias(f"_{c}") for c in docs.columns))
    model = train(docs, labels, id_col, text_col)
    kept = score(plain, model, f"_{id_col}", f"_{text_col}", keep=plain.columns).filter("predicted = 1")
    return kept.select(*(F.col(f"_{c}").alias(c) for c in docs.columns))
