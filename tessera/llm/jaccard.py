"""Exact links by Jaccard likeness of word shingles: what SimHash near-dedup verifies its candidates by, and what makes its links complete.

A text is its set of shingle hashes; equal sets are one node. Each node carries a parity sketch of two bits or more a shingle: where two
sketches differ in x bits, the sets differ in x shingles at least, so most pairs that are not alike are dismissed without their sets, and
none that is. Pairs that pass are compared by their whole sets.

No SimHash radius holds every pair of a likeness. The rest is found by prefixes: under one order over all hashes, two sets at least t alike
share one of their first n - ceil(t * n) + 1 hashes. The order puts hashes that a sample finds in many texts last, so passages that many
texts share seldom bring texts together; any order finds every pair, only cost changes.

Nulls and edge cases: null and wordless texts are the empty set, which equals itself only; a text with fewer words than a shingle is one
shingle; repeated rows are one node; rows with a null id are kept and link others. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, raw, slices, window_hashes, word_hashes, words
from .components import components

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SLICE = 256 << 10
#: Places of ids in the bitmap that says whose sets are wanted: 1 MB, whatever the corpus holds.
BITMAP = 1 << 23


def shingle_sets(col: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `shingle` words, ASCII letters lower-cased."""
    data, offsets = raw(col)
    data = _LOWER[data]
    starts, ends, before = words(data, offsets)
    own = word_hashes(data, starts, ends)
    runs = window_hashes(own, shingle)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= shingle:
            yield np.unique(runs[a : b - shingle + 1])
        elif b > a:
            yield mix(window_hashes(own[a:b], b - a) ^ np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of how many hashes fall on each bit, as longs; 64 bits times a power of two, at least two bits a hash. Halves laid over each other give the next smaller sketch."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).view(np.int64)))


def common_hashes(docs: DataFrame, id_col: str, text_col: str, shingle: int, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that most rows of a sample hold, sorted, and their counts: at most `most`. They set the order of hashes, not the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, SLICE):
            found = [*shingle_sets(batch.column(0), shingle), np.zeros(0, np.uint64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    sample = docs.filter(F.pmod(F.xxhash64(id_col), F.lit(32)) == 0).select(text_col).mapInArrow(run, "h long")
    found = sample.groupBy("h").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "h").limit(most).toArrow()
    h, n = (found.column(c).to_numpy().astype(np.int64) for c in ("h", "n"))
    h = h.view(np.uint64)
    order = np.argsort(h)
    return h[order], n[order]


def prefix(s: np.ndarray, similarity: float, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The hashes, rare ones first, of which any set at least `similarity` alike shares one of its own."""
    if not len(s):
        return s
    known, often = hot
    take = len(s) - math.ceil(similarity * len(s) - 1e-9) + 1
    if len(known):
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        s = s[np.argsort(np.where(known[at] == s, often[at], 0), kind="stable")]
    return s[:take]


def wanted(ids: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of ids(id). Its words are put together on the executors; its size is fixed."""
    words_ = ids.select(F.pmod(F.xxhash64("id"), F.lit(BITMAP)).cast("int").alias("at")).groupBy(F.shiftright("at", 5).alias("word"))
    found = words_.agg(F.expr("bit_or(shiftleft(1L, at & 31))").alias("bits")).toArrow()
    out = np.zeros(BITMAP // 32, np.uint32)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _folded(x: Column, y: Column) -> Column:
    """x, or its halves laid over each other if it is longer than y."""
    half = (F.size(x) / 2).cast("int")
    return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))).otherwise(x)


class Links:
    """Verifies pairs of nodes of docs. nodes(node, least, n, sk): each distinct set, with the smallest id that has it; rows: how many."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, rows: int, scratch: Scratch, id_col: str, text_col: str, shingle: int, similarity: float):
        self.docs, self.nodes, self.rows, self.scratch = docs, nodes, rows, scratch
        self.id_col, self.text_col, self.shingle, self.similarity = id_col, text_col, shingle, similarity

    def _sets(self, needed: DataFrame) -> DataFrame:
        """(node, w) of needed(node, id). Only texts whose id is in the bitmap are looked at."""
        shared = self.docs.sparkSession.sparkContext.broadcast(np.packbits(wanted(needed.select("id"))))
        shingle = self.shingle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.unpackbits(shared.value).view(bool)

            def asked() -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield batch.filter(pa.array(bits[batch.column(0).to_numpy()]))

            for batch in slices(asked(), "text", SLICE):
                sets = list(shingle_sets(batch.column(1), shingle))
                yield pa.RecordBatch.from_arrays([pa.array(digests(sets)), lists(sets)], names=["node", "w"])

        rows = self.docs.select(F.pmod(F.xxhash64(self.id_col), F.lit(BITMAP)).alias("at"), F.col(self.text_col).alias("text")).mapInArrow(run, "node long, w array<long>")
        return rows.join(needed.select("node"), "node", "left_semi").dropDuplicates(["node"])

    def alike(self, pairs: DataFrame) -> DataFrame:
        """pairs(a, b), a < b -> those that are at least `similarity` alike."""
        t = self.similarity
        side = lambda c: self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sk").alias(f"s{c}"), F.col("least").alias(f"i{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        differ = F.zip_with(_folded(F.col("sa"), F.col("sb")), _folded(F.col("sb"), F.col("sa")), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        apart = F.aggregate(differ, F.lit(0), lambda x, y: x + y)
        sized = (F.col("na") >= F.col("nb") * t - 1e-9) & (F.col("nb") >= F.col("na") * t - 1e-9)
        near = self.scratch.table(both.filter(sized).filter(apart <= (F.col("na") + F.col("nb")) * ((1 - t) / (1 + t)) + 1e-9).select("a", "b", "ia", "ib"), "near", self.rows)
        needed = near.select(F.col("a").alias("node"), F.col("ia").alias("id")).unionByName(near.select(F.col("b").alias("node"), F.col("ib").alias("id"))).distinct()
        sets = self.scratch.table(self._sets(needed), "sets", self.rows)
        shared = F.size(F.array_intersect("x", "y"))
        whole = near.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        out = self.scratch.table(whole.filter(shared >= t * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b"), "links", self.rows)
        self.scratch.drop(near, sets)
        return out


def complete(found: DataFrame, nodes: DataFrame, links: Links) -> DataFrame:
    """found(a, b): links so far; nodes(node, n, first): prefixes -> found and links that join all that is alike and is not joined yet.

    Two sets meet at a hash of both prefixes if they are in different components and, were this hash the first that they share, what stands behind
    it in either could still make them alike (positions). A true pair passes at its first common hash; copies of one text with edits of
    their own, which share their later hashes with thousands, do not meet there.
    """
    t = links.similarity
    roots = links.scratch.table(components(found, links.scratch, links.rows), "roots", links.rows)
    joined = nodes.join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"), F.posexplode("first").alias("i", "h"))
    several = joined.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("h")
    places = links.scratch.table(joined.join(several, "h", "left_semi"), "places")
    rest = F.least(F.col("l.n") - F.col("l.i"), F.col("r.n") - F.col("r.i"))
    could = (rest >= (F.col("l.n") + F.col("r.n")) * (t / (1 + t)) - 1e-9) & (F.col("l.n") >= F.col("r.n") * t - 1e-9) & (F.col("r.n") >= F.col("l.n") * t - 1e-9)
    pairs = places.alias("l").join(places.alias("r"), "h").filter((F.col("l.node") < F.col("r.node")) & (F.col("l.root") != F.col("r.root")) & could)
    new = links.alike(pairs.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct())
    links.scratch.drop(places)
    return links.scratch.table(found.unionByName(new), "found", links.rows)
