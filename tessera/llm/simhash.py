"""SimHash near-duplicates: fingerprints, then generalised pigeonhole search for those few bits apart.

Fingerprints are made where the texts are read; only (id, 8 bytes) leave that stage. Exact copies share a fingerprint and
are one node from then on. For the distinct fingerprints, bits that correlate over the corpus are grouped into the same
partition, and each partition gets its own threshold t (-1: not probed) by dynamic programming over estimated candidate
counts. The thresholds sum to max_bits - m + 1 over m partitions, so two fingerprints at most max_bits apart are within t
bits in at least one partition (general pigeonhole principle): no pair is lost for any choice, only cost changes. A
partition with threshold t is probed by its value with each choice of t bits blanked; fingerprints that meet in a
probe are verified by their full distance. A meeting place hands on a spanning forest of its links, never all its pairs.

Nulls and edge cases: a null or wordless text has fingerprint zero and links like any other; a text with fewer words than
a shingle is one shingle; repeated rows share component and fingerprint; a null id is kept and takes the component of its
fingerprint's smallest non-null id (null if there is none). Other columns pass through untouched where a function
says so. An empty table gives an empty result. near_duplicates links by bits alone; similar() links by the Jaccard likeness of the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jaccard
from .common import Scratch, give_back, raw, slices
from .components import components

#: So many ids at most are broadcast to take rows out (8 MB of longs).
FEW_IDS = 1_000_000
_BYTE_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, shingle: int, seed: int) -> list[int]:
    """XXH64 of each run of `shingle` words of the lower-cased text, joined by single spaces."""
    found = text.lower().split()
    if len(found) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(found), seed)] if found else []
    joined = b" ".join(found)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps[: len(gaps) - shingle + 1] + 1).tolist()], [*gaps[shingle - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document, the 64 bits that are set in over half of its hashes. hashes: of all documents in turn; counts: how many each has."""
    out = np.zeros(len(counts), np.uint64)
    has = np.flatnonzero(counts)
    if not len(has):
        return out
    n = counts[has]
    blocks = -(-n // 255)  # byte lanes count to 255
    first = np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), blocks)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    cuts, docs = first[of] + 255 * nth, np.cumsum(blocks) - blocks
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _BYTE_LANES, cuts)
        totals = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), docs, axis=0)
        set_ = (2 * totals > n[:, None]).astype(np.uint64)
        for lane in range(8):
            out[has] |= set_[:, lane] << np.uint64(8 * lane + bit)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp long): the fingerprint's 64 bits as a signed long."""
    schema = T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            data, offsets = raw(batch.column(1))
            body, hashes, counts = data.tobytes(), [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = shingle_hashes(body[a:b], shingle, seed)
                counts.append(len(own))
                hashes.append(np.array(own, np.uint64))
            fp = majority(np.concatenate(hashes), np.array(counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


@dataclass(frozen=True)
class Plan:
    """groups: bit numbers by partition; thresholds: t of each; cost: the estimate that chose them."""

    groups: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float

    def masks(self) -> list[int]:
        """For each probe of a fingerprint, the bits that must agree."""
        from itertools import combinations

        out = []
        for bits, t in zip(self.groups, self.thresholds, strict=True):
            if t >= 0:
                out += [sum(1 << b for b in bits if b not in gone) for gone in combinations(bits, t)]
        return out


def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of bits set together over all rows of fps(fp): added up on the executors, a fixed-size result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
            for at in range(0, len(fp), 1 << 16):
                bits = np.unpackbits(fp[at : at + (1 << 16)], axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
        i, j = np.indices((64, 64))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "n"])

    out = np.zeros((64, 64), np.int64)
    for r in fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r.i, r.j] = r.n
    return out


def plan(together: np.ndarray, rows: int, max_bits: int) -> Plan:
    """Chooses the number of partitions, their bits and their thresholds from pairwise bit counts over all fingerprints."""
    n = max(rows, 1)
    p = np.diag(together) / n
    var = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / n - np.outer(p, p)) / np.outer(var, var))
    np.fill_diagonal(corr, 0)
    p11 = together / n
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    p00 = 1 - p11 - p10 - p01
    agree = p * p + (1 - p) * (1 - p)  # that a random pair agrees in a bit
    both = p11**2 + p10**2 + p01**2 + p00**2  # that it agrees in two bits

    def within(bits: list[int]) -> np.ndarray:
        """Probability that a random pair differs in at most t of bits, by a chain of neighbouring bits."""
        state = np.zeros((2, max_bits + 2))
        state[1, 0], state[0, 1] = agree[bits[0]], 1 - agree[bits[0]]
        for a, b in zip(bits, bits[1:], strict=False):
            same = both[a, b] / max(agree[a], 1e-12)  # b agrees where a does
            other = (agree[b] - both[a, b]) / max(1 - agree[a], 1e-12)  # b agrees where a differs
            new = np.zeros_like(state)
            new[1] = state[1] * same + state[0] * other
            differs = state[1] * (1 - same) + state[0] * (1 - other)
            new[0, 1:] = differs[:-1]
            new[0, -1] += differs[-1]
            state = new
        return np.cumsum(state.sum(axis=0))[:-1]

    best = None
    for m in range(min(2, max_bits + 1), max_bits + 2):
        left, groups = set(range(64)), []
        for k in range(m):
            width = len(left) // (m - k)
            group = [max(left, key=lambda b: (corr[b, list(left)].sum(), -b))]
            left.discard(group[0])
            while len(group) < width:
                nxt = max(left, key=lambda b: (corr[b, group].mean(), -b))
                group.append(nxt)
                left.discard(nxt)
            groups.append(group)
        need = max_bits - m + 1
        # cost[k][s]: least cost of the first k partitions with thresholds that sum to s; a probe row costs 20 verified pairs
        table = {0: (0.0, ())}
        for bits in groups:
            chance, new = within(bits), {}
            for s, (cost, chosen) in table.items():
                for t in range(-1, max_bits + 1):
                    if t >= len(bits):
                        break
                    probes = 0
                    if t >= 0:
                        probes = 1
                        for x in range(t):
                            probes = probes * (len(bits) - x) // (x + 1)
                    if probes > 4096:
                        break
                    own = cost + (20 * n * probes + n * n * chance[t] * (1 + t) if t >= 0 else 0)
                    if s + t not in new or own < new[s + t][0]:
                        new[s + t] = (own, (*chosen, t))
            table = new
        if need in table and (best is None or table[need][0] < best.cost):
            best = Plan(tuple(map(tuple, groups)), table[need][1], table[need][0])
    return best


def forest(fps: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """Links that span the components of distinct fingerprints at most max_bits apart: each is compared with those not reached yet."""
    a, b, rest = [], [], fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                found = rest[near]
                a += [int(x)] * len(found)
                b += found.tolist()
                queue.extend(found)
                rest = rest[~near]
    return a, b


def links(fps: DataFrame, max_bits: int, chosen: Plan) -> DataFrame:
    """fps(fp), distinct -> (a, b): links at most max_bits apart that connect all that can be connected.

    Rows with equal probes are brought together by one shuffle and read in sorted order as a stream. Small groups are
    verified side by side by shifted comparisons; a large one is held as one array of 8 bytes a fingerprint and searched
    breadth first, which compares each fingerprint only with those not reached yet: a group of near copies, all near the
    first, costs as many comparisons as it has members.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen.masks()]
    probes = fps.select(F.col("fp"), F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("k", "v"))
    small = 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def verified(k: np.ndarray, v: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole groups in order."""
            new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])]))
            sizes = np.diff(np.append(new, len(k)))
            few = np.repeat(sizes <= small, sizes)
            left = np.repeat(new + sizes, sizes) - np.arange(len(k))  # rows from here to the group's end
            a, b = [], []
            for d in range(1, small):
                i = np.flatnonzero(few & (left > d))
                i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= max_bits]
                a.append(fp[i])
                b.append(fp[i + d])
            for at, size in zip(new[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
                x, y = forest(fp[at : at + size], max_bits)
                a.append(np.array(x, np.uint64))
                b.append(np.array(y, np.uint64))
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[tuple] = []
        for batch in batches:
            k, v = (batch.column(x).to_numpy(zero_copy_only=False) for x in (0, 1))
            fp = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if not len(k):
                continue
            last = np.flatnonzero((k != k[-1]) | (v != v[-1]))
            cut = last[-1] + 1 if len(last) else 0  # the last group may go on
            if cut == 0 and held and held[-1][0][-1] == k[0] and held[-1][1][-1] == v[0]:
                held.append((k, v, fp))
                continue
            held.append((k[:cut], v[:cut], fp[:cut]))
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            if len(whole[0]):
                yield from verified(*whole)
            held = [(k[cut:], v[cut:], fp[cut:])]
        if held:
            yield from verified(*(np.concatenate(x) for x in zip(*held, strict=True)))
        give_back()

    return probes.select("k", "v", "fp").repartition("k", "v").sortWithinPartitions("k", "v").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, max_bits: int = 4) -> DataFrame:
    """(id, fp long, fingerprint string of 16 hex digits, component_id): component_id is the smallest id that chains of links reach."""
    scratch = Scratch(docs.sparkSession)
    own = scratch.table(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    distinct = scratch.table(own.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    rows = distinct.count()
    roots = components(links(distinct.select("fp"), max_bits, plan(bit_counts(distinct), rows, max_bits)), scratch, rows)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.table(rooted, "rooted", rows)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = scratch.table(rooted.join(least, "root").select("fp", "component_id"), "labels", rows)
    scratch.drop(distinct, rooted)
    return own.join(labels, "fp").select(id_col, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, max_bits: int = 4) -> DataFrame:
    """docs without those rows whose component has a smaller id. Rows that repeat an id stay if one of them is its component's; null ids stay."""
    return _kept(docs, near_duplicates(docs, id_col, text_col, shingle, seed, max_bits), id_col)


def _kept(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    stays = F.bool_or(F.col(id_col) == F.col("component_id"))
    gone = scratch.table(found.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(stays.alias("_stays")).filter("not _stays").select(F.col(id_col).alias("_gone_id")), "gone", found.count())
    few = gone.count() <= FEW_IDS  # else the texts are dealt out by id
    return docs.join(F.broadcast(gone) if few else gone, F.col(id_col) == F.col("_gone_id"), "left_anti").select(*docs.columns)


def marked(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(id, node: digest of the set of shingles, fp: SimHash of the set, n: its size, sk: its parity sketch, first: the hashes of its prefix), in one pass over the texts."""
    hot = jaccard.common_hashes(docs, id_col, text_col, shingle)
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("node", "fp", "n")), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("sk", "first"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, jaccard.SLICE):
            sets = list(jaccard.shingle_sets(batch.column(1), shingle))
            n = np.array([len(s) for s in sets])
            fp = majority(np.concatenate(sets), n).view(np.int64)
            lists = (jaccard.lists([jaccard.sketch(s) for s in sets]), jaccard.lists([jaccard.prefix(s, similarity, hot) for s in sets]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(jaccard.digests(sets)), pa.array(fp), pa.array(n), *lists], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, max_bits: int = 8) -> DataFrame:
    """(id, component_id): component_id is the smallest id that chains of pairs at least `similarity` alike (Jaccard, sets of shingles) reach.

    Fingerprints at most max_bits apart give the first candidates, found as in near_duplicates, and each is verified by its sets. They join
    most of what is alike and all that makes large groups. No radius promises a likeness, so links that it leaves out are found by
    jaccard.complete, between components only: the result is exact for every max_bits, only cost changes.
    """
    scratch = Scratch(docs.sparkSession)
    whole = scratch.table(marked(docs, id_col, text_col, shingle, similarity), "marked")
    nodes = scratch.table(whole.groupBy("node").agg(F.min(id_col).alias("least"), *(F.any_value(c).alias(c) for c in ("fp", "n", "sk", "first"))), "nodes")
    rows = scratch.table(whole.select(id_col, "node"), "rows")
    scratch.drop(whole)
    n = nodes.count()
    links_ = jaccard.Links(docs, nodes.select("node", "least", "n", "sk"), n, scratch, id_col, text_col, shingle, similarity)
    some = nodes.filter("n > 0").select("node", "fp")
    distinct = scratch.table(some.groupBy("fp").agg(F.min("node").alias("of")), "distinct", n)
    near = links(distinct.select("fp"), max_bits, plan(bit_counts(distinct), distinct.count(), max_bits))
    near = near.join(distinct.toDF("a", "x"), "a").join(distinct.toDF("b", "y"), "b").select("x", "y")
    same = some.join(distinct, "fp").filter("node <> of").select(F.col("of").alias("x"), F.col("node").alias("y"))
    found = links_.alike(near.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    roots = components(jaccard.complete(found, nodes.select("node", "n", "first"), links_), scratch, n)
    rooted = scratch.table(nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted", n)
    label = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = scratch.table(rooted.join(label, "root").select("node", "component_id"), "labels", n)
    out = scratch.table(rows.select(id_col, "node").join(labels, "node").select(id_col, "component_id"), "classes", n)
    scratch.drop(rows, nodes, distinct, rooted, labels)
    return out


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each class of similar(): the one with the smallest id. Rows that repeat an id stay if one of them is its class's; null ids stay."""
    return _kept(docs, similar(docs, id_col, text_col, shingle, similarity), id_col)
