"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

Every character is in one leaf: a sentence with the spaces around it, long ones in pieces of 16 words. A paragraph is a line with its line
break, and its digest is the hash of its leaves; a section's digest is the hash of its paragraphs' digests, the root that of its sections'
digests. A heading line, or a line behind blank ones, begins a section; blank lines are paragraphs of the section before them. The fingerprint
writes the tree down, `root|section;section`: a section is `digest size:paragraph/paragraph`, a paragraph its leaves with commas between, a leaf
16 digits of digest and its size (sizes in code points, hexadecimal, without the space). Equal roots mean equal texts; otherwise equal
branches are passed over whole, and the walk down those that differ gives the likeness and the place of the edit.

Nulls and edge cases: a null text counts as empty; an empty text has a tree without sections; ids are integers and may repeat: rows are
ordered by id and then by their compressed bytes, and each is a document of its own; null ids come first and are dealt to one task; a table of one row is its own
next document. Texts of any length are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small_batches

PIECE_WORDS = 16
_SENTENCE = re.compile(r"[^.!?]*[.!?]*")
_HEADING = re.compile(r"#{1,6} ")
DIGITS = 16


def leaves(paragraph: str) -> list[str]:
    """The paragraph's sentences, long ones in pieces; put together they are the paragraph."""
    out = []
    for s in _SENTENCE.findall(paragraph):
        if len(s) > 6 * PIECE_WORDS:
            found = s.split(" ")
            out += [" ".join(found[k : k + PIECE_WORDS]) + " " * (k + PIECE_WORDS < len(found)) for k in range(0, len(found), PIECE_WORDS)]
        elif s:
            out.append(s)
    return out


def sections(text: str) -> Iterator[list[str]]:
    """The lines of each section, with their line breaks."""
    own: list[str] = []
    blank = False
    *whole, last = text.split("\n")
    for line in (*(x + "\n" for x in whole), last):
        empty = not line.strip()
        if own and not empty and (blank or _HEADING.match(line)):
            yield own
            own = []
        if line:
            own.append(line)
            blank = empty
    if own:
        yield own


def tree(text: str) -> str:
    """The fingerprint of a text."""
    digest, out = xxhash.xxh64_hexdigest, []
    for lines in sections(text):
        paragraphs = [",".join([f"{digest(x.encode())}{len(x):x}" for x in leaves(line)]) for line in lines]
        own = digest("".join([digest(p) for p in paragraphs]))
        out.append(f"{own}{sum(map(len, lines)):x}:{'/'.join(paragraphs)}")
    root = hashlib.sha256("".join([x[:DIGITS] for x in out]).encode()).hexdigest()[:32]
    return f"{root}|{';'.join(out)}"


def _nodes(fingerprint: str) -> list[tuple[str, str]]:
    """(digest and size, paragraphs) of each section."""
    return [(head, body) for head, _, body in (x.partition(":") for x in filter(None, fingerprint.partition("|")[2].split(";")))]


def _size(leaf: str) -> int:
    return int(leaf[DIGITS:], 16)


def _rest(one: Iterable[str], other: Iterable[str]) -> tuple[list[str], list[str], list[str]]:
    """Branches that both have (as often as both have them), and what either has besides."""
    a, b = Counter(one), Counter(other)
    same = a & b
    return list(same.elements()), list((a - same).elements()), list((b - same).elements())


def likeness(one: str, other: str) -> float:
    """0 to 1: twice the size of what both trees have over the size of both; 1 for equal roots. Only branches that differ are gone down."""
    if one[:32] == other[:32]:
        return 1.0
    a, b = _nodes(one), _nodes(other)
    total = sum(_size(head) for head, _ in a) + sum(_size(head) for head, _ in b)
    if not total:
        return 0.0
    same, left, right = _rest((head for head, _ in a), (head for head, _ in b))
    common = sum(map(_size, same))
    bodies = dict(a) | dict(b)  # equal digests have equal bodies
    # a paragraph's digest is the hash of its leaves: equal leaves, equal digests
    same, left, right = _rest((p for h in left for p in bodies[h].split("/")), (p for h in right for p in bodies[h].split("/")))
    common += sum(_size(x) for p in same for x in p.split(","))
    same, _, _ = _rest((x for p in left for x in p.split(",")), (x for p in right for x in p.split(",")))
    return 2 * (common + sum(map(_size, same))) / total


def edited_at(one: str, other: str) -> int | None:
    """Code points before the first leaf that differs (also where one text goes on and the other ends); null for equal roots."""
    if one[:32] == other[:32]:
        return None
    at = 0
    for (x, xs), (y, ys) in zip(_nodes(one), _nodes(other), strict=False):
        if x == y:
            at += _size(x)
            continue
        for p, q in zip(xs.split("/"), ys.split("/"), strict=False):
            for u, v in zip(p.split(","), q.split(","), strict=False):
                if u != v:
                    return at
                at += _size(u)
            if p != q:
                return at
        return at
    return at


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint): made where the texts are read, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tree(t or "") for t in batch.column(1).to_pylist()])], names=[id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("fingerprint", T.StringType())]))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edit_at): each document, and the next one by id (after the last: the first).

    The edited text is the document with its last quarter replaced by the next one's beginning. Documents are dealt out by
    ranges of ids, so neighbours meet in one task. Only ids are sorted to find where ranges begin (one value per partition
    on the driver), and the first row of each range is also sent to the range before it. Texts move once, compressed.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col), F.lit(-(1 << 63)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.select(key.alias("k")).repartitionByRange(parts, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k"))
    begins = np.array(sorted(r.k for r in found.collect()), np.int64)
    dealt = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("copy", T.BooleanType()), docs.schema[id_col], T.StructField("z", T.BinaryType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for batch in slices(batches, text_col):
            k = batch.column(2).to_numpy()
            part = np.searchsorted(begins, k, side="right") - 1
            z = pa.array([pack.compress((t or "").encode()) for t in batch.column(1).to_pylist()], pa.binary())
            first = np.flatnonzero(k == begins[part])
            for copy, rows, to in ((False, np.arange(len(k)), part), (True, first, (part[first] - 1) % len(begins))):
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(np.full(len(rows), copy)), batch.column(0).take(pa.array(rows)), z.take(pa.array(rows))], names=dealt.names)

    schema = T.StructType([docs.schema[id_col], T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), *(T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")), T.StructField("edit_at", T.LongType())])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        last = None  # (part, id, text, fingerprint) of a row that waits for its next
        for batch in slices(batches, "z", 1 << 20):
            rows = []
            for part, copy, doc, z in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if copy and (last is None or last[0] != part):
                    continue  # a further copy
                text = unpack.decompress(z).decode()
                own = tree(text)
                if last is not None and last[0] == part:
                    _, prev, old, fingerprint = last
                    quarter = len(old) // 4
                    edited = old[: len(old) - quarter] + text[:quarter]
                    new = tree(edited)
                    rows.append((prev, len(old), hashlib.sha256(edited.encode()).hexdigest(), fingerprint, new, likeness(fingerprint, new), likeness(fingerprint, own), edited_at(fingerprint, new)))
                last = None if copy else (part, doc, text, own)
            kinds = [batch.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=schema.names)

    moved = docs.select(F.col(id_col), F.col(text_col), key.alias("_k")).mapInArrow(deal, dealt)
    return moved.repartitionById(max(1, len(begins)), "part").sortWithinPartitions("part", "copy", id_col, "z").mapInArrow(pair, schema)
