"""Alignment of two tokenizers over the same texts.

Both tokenizers cut the same bytes. The tokens of B are a static index of byte intervals (sorted starts and ends); each
token of A asks by bisection which of them it overlaps, and spans the gaps between those. A gap between two tokens of B
that no token of A spans is a byte offset where tokens of both end: there a group ends.

Corpus counts of linked id pairs go back to the texts without a hot key: the most frequent pairs, at most BROADCAST_PAIRS
of them, are broadcast and looked up where the links lie, and only links of rarer pairs are shuffled. The same holds at
every size, and every link meets its count.

Nulls and edge cases: texts that are null or empty, or whose tokens of A or B don't give back space + text, have no tokens:
zeros and an empty alignment. Names of special tokens inside a text are plain text. Rows are told apart by a number of their
own, so rows that repeat an id, or a text, each count as a document; a null id is an id like any other. Other columns than
those asked for are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, frequent, give_back, slices, small_batches

#: The most frequent id pairs whose counts are broadcast: 12 bytes each, some 10 MB as a table.
BROADCAST_PAIRS = 1 << 18
#: Links of a slice that are worked on at once.
LINKS_AT_ONCE = 1 << 21


def byte_letters() -> dict[str, int]:
    """The letters of byte-level vocabularies: printable bytes stand for themselves, the others for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Byte:
    """A byte-level BPE from its JSON file: encodes space + text.

    If merges stand in the order of the ids that they make, the ids are ranks, and with the pattern that byte-level splitting stands for the
    rank library encodes, which is several times as fast; other files, and texts that it cannot take, go through the file's own library.
    """

    def __init__(self, content: bytes, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.encode_special_tokens = True
        letters, vocabulary = byte_letters(), self.tokenizer.get_vocab()
        self.table = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for piece, i in vocabulary.items():
            self.table[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.ranked = None
        found = json.loads(content)
        model, added = found["model"], {t["id"] for t in found.get("added_tokens", ())}
        merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model.get("merges", ())]
        plain = model.get("type") == "BPE" and not model.get("ignore_merges") and not model.get("dropout") and found.get("normalizer") is None
        split = found.get("pre_tokenizer") or {}
        if pattern and plain and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and merged == sorted(set(merged)) and len(set(merged) | added) + 256 == len(vocabulary):
            import tiktoken

            self.ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={b: i for i, b in enumerate(self.table) if i not in added}, special_tokens={})

    def _own(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        texts = [" " + t for t in texts]
        if self.ranked is None:
            return self._own(texts)
        out = []
        for t in texts:
            try:
                out.append(self.ranked.encode_ordinary(t))
            except BaseException as wrong:  # noqa: BLE001  its panics, as on very long runs of spaces, are no Exceptions
                if isinstance(wrong, KeyboardInterrupt | SystemExit):
                    raise
                out += self._own([t])
        return out


class Piece:
    """A sentencepiece model, which puts the space before the text by itself."""

    def __init__(self, content: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=content)
        of = self.model.id_to_piece
        self.table = [bytes([int(of(i)[3:5], 16)]) if self.model.is_byte(i) else of(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Side:
    """The tokens of one tokenizer over the texts of a slice, laid end to end: ids, where they start and end, the text of each."""

    def __init__(self, table: list[bytes], sizes: np.ndarray, lists: list[list[int]]):
        counts = np.array([len(x) for x in lists], np.int64)
        self.ids = np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum()))
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.text = np.repeat(np.arange(len(lists)), counts)
        self.ends = np.cumsum(sizes[self.ids])
        self.starts = self.ends - sizes[self.ids]
        self.table = table

    def same(self, texts: Iterable[bytes]) -> bool:
        """Whether the tokens of all texts give these back, each in its place."""
        texts = list(texts)
        ends = np.concatenate([[0], self.ends])[self.first]
        sizes = np.diff(ends)
        return sizes[sizes > 0].tolist() == [len(t) for t in texts] and b"".join(map(self.table.__getitem__, self.ids.tolist())) == b"".join(texts)

    def spelled(self, k: int) -> bytes:
        return b"".join([self.table[i] for i in self.ids[self.first[k] : self.first[k + 1]].tolist()])


def groups(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of a and of b. Both tile the same bytes."""
    if not len(b.ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    from_, to = np.searchsorted(b.ends, a.starts, "right"), np.searchsorted(b.starts, a.ends, "left")  # the overlap list is from_ to to
    spans = np.zeros(len(b.ids) + 1, np.int64)  # entry g: of the gap before token g
    np.add.at(spans, from_ + 1, 1)
    np.add.at(spans, to, -1)
    of_b = np.cumsum(np.cumsum(spans)[: len(b.ids)] == 0) - 1  # the gap before the very first token is not spanned
    return of_b[from_], of_b


def linked(a: Side, b: Side, of_a: np.ndarray, of_b: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, times): the distinct linked id pairs of each text. pair: id of a * wide + id of b."""
    n = int(of_b[-1]) + 1 if len(of_b) else 0
    size = np.bincount(of_b, minlength=n)
    first = np.cumsum(size) - size
    each, top = size[of_a], int(a.ids.max(initial=0) + 1) * wide
    ends = np.cumsum(each)
    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = 0
    while at < len(of_a):  # a token of a at a time at least
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + LINKS_AT_ONCE, "right")))
        own = each[at:to]
        inside = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        other = b.ids[np.repeat(first[of_a[at:to]], own) + inside]
        found, count = np.unique(np.repeat(a.text[at:to] * top + a.ids[at:to] * wide, own) + other, return_counts=True)
        if len(keys):
            both = np.concatenate([keys, found])
            keys, where = np.unique(both, return_inverse=True)
            times = np.bincount(where, np.concatenate([times, count]), len(keys)).astype(np.int64)
        else:
            keys, times = found, count
        at = to
    return keys // max(1, top), keys % max(1, top), times


class Writing:
    """Writes groups as a1,a2|b1;a3|b2,b3."""

    def __init__(self, n_a: int, n_b: int):
        self.a = [np.array([f"{i}{c}" for i in range(n_a)], object) for c in ",|"]
        self.b = [np.array([f"{i}{c}" for i in range(n_b)], object) for c in ",;"]

    def lines(self, a: Side, b: Side, of_a: np.ndarray, of_b: np.ndarray, n_texts: int) -> list[str]:
        if not len(b.ids):
            return [""] * n_texts
        n = int(of_b[-1]) + 1
        before_a, before_b = (np.concatenate([[0], np.cumsum(np.bincount(x, minlength=n))]) for x in (of_a, of_b))
        out = np.empty(len(a.ids) + len(b.ids), object)
        for side, of, table, place in ((a, of_a, self.a, np.arange(len(a.ids)) + before_b[of_a]), (b, of_b, self.b, np.arange(len(b.ids)) + before_a[of_b + 1])):
            last = np.append(of[1:] != of[:-1], True)
            out[place[~last]] = table[0][side.ids[~last]]
            out[place[last]] = table[1][side.ids[last]]
        cut = a.first + b.first
        return ["".join(out[x:y].tolist())[:-1] for x, y in zip(cut.tolist(), cut[1:].tolist(), strict=False)]


class Pair:
    """Both tokenizers; made once in each Python worker."""

    made: dict[tuple, Pair] = {}

    def __init__(self, a: Byte, b: Piece):
        self.a, self.b = a, b
        self.sizes = [np.array([len(x) for x in t.table], np.int64) for t in (a, b)]
        self.writing = Writing(len(a.table), len(b.table))

    @classmethod
    def get(cls, a: bytes, b: bytes, pattern: str | None = None) -> Pair:
        if (a, b, pattern) not in cls.made:
            cls.made.clear()
            cls.made[a, b, pattern] = cls(Byte(a, pattern), Piece(b))
        return cls.made[a, b, pattern]

    def sides(self, texts: list[str | None]) -> tuple[Side, Side]:
        """The tokens of both; texts that either does not give back have none."""
        lists = [[[]] * len(texts), [[]] * len(texts)]
        some = [k for k, t in enumerate(texts) if t]
        for own, tokenizer in zip(lists, (self.a, self.b), strict=True):
            for k, ids in zip(some, tokenizer.ids([texts[k] for k in some]), strict=True):
                own[k] = ids
        out = [Side(t.table, s, x) for t, s, x in zip((self.a, self.b), self.sizes, lists, strict=True)]
        whole = {k: (" " + texts[k]).encode() for k in some}
        wrong = [] if all(side.same(whole.values()) for side in out) else [k for k in some if any(side.spelled(k) != whole[k] for side in out)]
        if wrong:
            for own in lists:
                for k in wrong:
                    own[k] = []
            out = [Side(t.table, s, x) for t, s, x in zip((self.a, self.b), self.sizes, lists, strict=True)]
        return out[0], out[1]


_LINK = T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.IntegerType())])


def align(docs: DataFrame, a: str, b: str, keep: list[str] | None = None, text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """The columns in keep (all by default) and row, n_a, n_b, n_groups, n_links, alignment, links. a, b: paths of the two vocabularies on the driver.
    pattern: the regex by which a splits texts, see Byte; the ids are the same without it.

    alignment: the groups as `a1,a2|b1;a3|b2,b3`, ids in order. links: the distinct linked pairs, each as id of a * size of b + id of b, and how often.
    row: a number of the row, of its task and place; it differs between runs of a task over other splits, so write the table before it is joined.
    """
    small_batches(docs.sparkSession)
    files = []
    for path in (a, b):
        with open(path, "rb") as f:
            files.append(docs.sparkSession.sparkContext.broadcast(f.read()))
    keep = list(docs.columns if keep is None else keep)
    new = [*(T.StructField(c, T.LongType()) for c in ("row", "n_a", "n_b", "n_groups", "n_links")), T.StructField("alignment", T.StringType()), T.StructField("links", T.ArrayType(_LINK))]
    keep = [c for c in keep if c not in {f.name for f in new}]  # columns of these names are replaced
    schema = T.StructType([*(docs.schema[c] for c in keep), *new])
    columns = list(dict.fromkeys([*keep, text_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        both = Pair.get(files[0].value, files[1].value, pattern)
        wide, row = len(both.b.table), TaskContext.get().partitionId() << 40
        for batch in slices(batches, text_col, 1 << 19):
            n = batch.num_rows
            a, b = both.sides(batch.column(columns.index(text_col)).to_pylist())
            of_a, of_b = groups(a, b)
            text, pair, times = linked(a, b, of_a, of_b, wide)
            opens = np.append(True, of_b[1:] != of_b[:-1])[: len(of_b)]
            counts = [np.arange(row, row + n), np.diff(a.first), np.diff(b.first), np.bincount(b.text[opens], minlength=n), np.bincount(text, times, n).astype(np.int64)]
            links = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(pair), pa.array(times.astype(np.int32))], ["pair", "times"]))
            lines = pa.array(both.writing.lines(a, b, of_a, of_b, n), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in keep), *map(pa.array, counts), lines, links], names=schema.names)
            row += n
            del batch, a, b, of_a, of_b, text, pair, times, links, lines
        give_back()

    return docs.select(*columns).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, wide: int) -> DataFrame:
    """(pair, n, best): in how many rows of aligned a pair is linked, and whether no other pair of its id of a is in more."""
    n = aligned.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.expr(f"pair div {wide}"))
    top = n.groupBy("a").agg(F.max("n").alias("top"))
    return n.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def scored(aligned: DataFrame, wide: int, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """aligned: a written table of align() (row and links are read). Without links; with n_best and count_sum: a row's links whose count is their id of a's highest, and the sum of all links' counts."""
    scratch = Scratch(aligned.sparkSession)
    counts = scratch.table(pair_counts(aligned, wide), "pair-counts")
    least = frequent(counts, broadcast_pairs)
    links = aligned.select("row", F.inline("links"))
    common, rare = F.broadcast(counts.filter(F.col("n") >= least)), counts.filter(F.col("n") < least)
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    near = links.join(common, "pair").groupBy("row").agg(*sums)
    far = links.join(common.select("pair"), "pair", "left_anti").join(rare, "pair").groupBy("row").agg(*sums)
    total = near.unionByName(far).groupBy(F.col("row").alias("_row")).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = aligned.drop("links", "n_best", "count_sum")
    return rows.join(total, F.col("row") == F.col("_row"), "left").drop("_row").fillna(0, ["n_best", "count_sum"])


def piece_count(b: str) -> int:
    """How many ids the vocabulary b has."""
    with open(b, "rb") as f:
        return len(Piece(f.read()).table)
