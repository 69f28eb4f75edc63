"""Exact substring deduplication by level-wise doubling.

Level one looks at runs of length // 2 words, level two at windows of `length` words, and each further level at twice
the length before; only what repeats in another document at one level is extended to the next.

- Level one is thinned without loss: of each window of `length` words the run with the least hash (leftmost on ties) is its
  anchor. Equal windows have equal anchors, so windows whose anchor is in one document alone cannot repeat.
- Level two hashes the windows of surviving anchors to 96 bits. A window that is also in a document with a smaller id is a
  repeat, and the words that it covers are removed.
- Further levels (`longest_repeats`) name a window of 2L words by the names of its halves, as in prefix doubling, until no
  candidate survives; texts are not read again.

A key's rows meet in windowed aggregates over sorted, spillable runs of small rows; texts meet only their own positions.
Documents are compressed while they are moved. Nulls and edge cases: a null text has no words; texts shorter than a window
keep all words; a null id is never removed from and removes nothing; rows that repeat an id count as one document, and
words go from the row whose text has the window (a hash of the text stands beside the id); equal windows inside one document are
no repeats. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import raw, slices, small_batches, window_hashes, word_hashes, words, Scratch


def _anchors(h: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `length` words inside one text: its start, and its anchor's word number. first: words before each text."""
    half = max(1, length // 2)
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.flatnonzero(of[:n] == of[length - 1 :])
    runs = window_hashes(h, half)
    best, at = runs[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, length - half + 1):
        less = runs[k : k + n] < best
        best[less] = runs[k : k + n][less]
        at[less] = k
    return starts, starts + at[starts]


def _texts(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a compressed column."""
    unpack = zstandard.ZstdDecompressor()
    found = [unpack.decompress(x) if x else b"" for x in batch.column(at).to_pylist()]
    return np.frombuffer(b"".join(found), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)


#: Tells rows of one id apart by their texts: a hash, or 0 in a table that repeats no id, which costs nothing where rows are moved.
TEXT = "_text"
_TEXT = T.StructField(TEXT, T.LongType())


def marked_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, _text)."""
    twice = not docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").isEmpty()
    return docs.select(id_col, text_col, (F.xxhash64(text_col) if twice else F.lit(0).cast("long")).alias(TEXT))


def packed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rows: marked_texts(). (id, _text, z): the text's bytes, compressed, for moving."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=7, write_content_size=True)
        for batch in slices(batches, text_col):
            out = [pack.compress(x.encode()) if x else None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=[id_col, TEXT, "z"])

    return rows.mapInArrow(run, T.StructType([rows.schema[id_col], _TEXT, T.StructField("z", T.BinaryType())]))


def anchors(rows: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """rows: marked_texts(). (seed, id, _text, pos): each row's anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            data, offsets = raw(batch.column(1))
            starts, ends, first = words(data, offsets)
            h = word_hashes(data, starts, ends)
            _, at = _anchors(h, first, length)
            at = np.unique(at)
            doc = np.searchsorted(first, at, side="right") - 1
            seed = window_hashes(h, max(1, length // 2))[at].view(np.int64) if len(at) else np.zeros(0, np.int64)
            own = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(seed), batch.column(0).take(own), batch.column(2).take(own), pa.array((at - first[doc]).astype(np.int32))], names=["seed", id_col, TEXT, "pos"])

    schema = T.StructType([T.StructField("seed", T.LongType()), rows.schema[id_col], _TEXT, T.StructField("pos", T.IntegerType())])
    return rows.filter(F.col(id_col).isNotNull()).mapInArrow(run, schema)


def repeated(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """rows of keys that more than one id has, with `least`, the smallest such id."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("least", F.min(id_col).over(w)).withColumn("most", F.max(id_col).over(w)).filter("least <> most").drop("most")


def _marked(texts: DataFrame, marks: DataFrame, id_col: str) -> DataFrame:
    """(id, _text, z, at): the texts with the positions of marks(id, _text, at array), null for rows without any."""
    own = marks.select(F.col(id_col).alias("_id"), F.col(TEXT).alias("_own"), "at")
    return texts.join(own, (F.col(id_col) == F.col("_id")) & (F.col(TEXT) == F.col("_own")), "left").select(id_col, TEXT, "z", "at")


def windows(texts: DataFrame, marked: DataFrame, id_col: str, length: int) -> DataFrame:
    """(h, x, id, _text, pos): the windows whose anchor's position is in marked(id, _text, at array), named by 96 bits."""
    # an outer join, as in dedup(): both then read one and the same shuffle of the texts
    joined = _marked(texts, marked, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "z", 1 << 20):
            batch = batch.filter(pc.and_(batch.column(2).is_valid(), batch.column(3).is_valid()))
            data, offsets = _texts(batch, 2)
            starts, ends, first = words(data, offsets)
            h = word_hashes(data, starts, ends)
            begin, anchor = _anchors(h, first, length)
            lists = batch.column(3)
            of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            wanted = np.zeros(len(h) + 1, bool)
            wanted[np.minimum(first[of] + lists.flatten().to_numpy(), len(h))] = True
            begin = begin[wanted[anchor]]
            doc = np.searchsorted(first, begin, side="right") - 1
            name = window_hashes(h, length)[begin] if len(begin) else np.zeros(0, np.uint64)
            more = window_hashes(word_hashes(data, starts, ends, 0xC2B2AE3D27D4EB4F), length, 0xFF51AFD7ED558CCD)[begin] if len(begin) else name
            own = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array((more >> np.uint64(32)).astype(np.uint32).view(np.int32)), batch.column(0).take(own), batch.column(1).take(own), pa.array((begin - first[doc]).astype(np.int32))], names=["h", "x", id_col, TEXT, "pos"])

    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("x", T.IntegerType()), texts.schema[id_col], _TEXT, T.StructField("pos", T.IntegerType())])
    return joined.mapInArrow(run, schema)


def doubled(level: DataFrame, id_col: str, length: int) -> DataFrame:
    """(h, x, id, _text, pos) repeated at `length` -> candidates at twice that: windows whose halves both repeat, named by their halves' names."""
    left = level.select(id_col, TEXT, "pos", "h", "x")
    right = level.select(id_col, TEXT, (F.col("pos") - length).alias("pos"), F.col("h").alias("h2"), F.col("x").alias("x2"))
    return left.join(right, [id_col, TEXT, "pos"]).select(F.xxhash64("h", "x", "h2", "x2").alias("h"), F.hash("x2", "h2", "x", "h").alias("x"), id_col, TEXT, "pos")


def repeats(rows: DataFrame, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13) -> DataFrame:
    """rows: marked_texts(), texts: packed(rows). (h, x, id, _text, pos, least): every window of `length` words that several documents share; least: the smallest id that has it."""
    seeds = repeated(anchors(rows, id_col, text_col, length), ["seed"], id_col)
    marked = seeds.groupBy(id_col, TEXT).agg(F.collect_list("pos").alias("at"))
    return repeated(windows(texts, marked, id_col, length), ["h", "x"], id_col)


def longest_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13) -> DataFrame:
    """(id, pos, words): for each document, the first of its longest windows (length, twice that, ...) that another document shares."""
    scratch = Scratch(docs.sparkSession)
    rows = marked_texts(docs, id_col, text_col)
    level = scratch.table(repeats(rows, packed(rows, id_col, text_col), id_col, text_col, length).drop("least"), "level")
    found, size = None, length
    while not level.isEmpty():
        own = level.groupBy(id_col).agg(F.min("pos").alias("pos")).withColumn("words", F.lit(size))
        found = own if found is None else found.unionByName(own)
        found = scratch.table(found.groupBy(id_col).agg(F.max_by("pos", "words").alias("pos"), F.max("words").alias("words")), "found")
        level = scratch.table(repeated(doubled(level, id_col, size), ["h", "x"], id_col).drop("least"), "level")
        size *= 2
    return found if found is not None else level.select(id_col, "pos", F.lit(size).alias("words"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept, spans): kept is the remaining words joined by single spaces; spans are the removed word ranges."""
    small_batches(docs.sparkSession)
    rows = marked_texts(docs, id_col, text_col)
    texts = packed(rows, id_col, text_col)
    found = repeats(rows, texts, id_col, text_col, length).filter(F.col(id_col) > F.col("least"))
    joined = _marked(texts, found.groupBy(id_col, TEXT).agg(F.collect_list("pos").alias("at")), id_col)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("spans", T.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches, "z", 1 << 20):
            rows = []
            for doc, z, at in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                found = unpack.decompress(z).split() if z else []
                n, spans, kept = len(found), [], found
                if at:
                    edge = np.zeros(n + length + 1, np.int32)
                    at = np.unique(np.array(at, np.int64))
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + length, -1)
                    gone = np.cumsum(edge)[:n] > 0
                    flips = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    spans = [{"start": a, "end": b} for a, b in flips.reshape(-1, 2).tolist()]
                    kept = [found[i] for i in np.flatnonzero(~gone).tolist()]
                text = b" ".join(kept)
                rows.append((doc, n, n - len(kept), hashlib.sha256(text).hexdigest(), text.decode(), spans))
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    return joined.mapInArrow(run, schema)
