"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece's bytes there is at most one token that can end a valid encoding of that prefix: a token t from
i to j ends the prefix j if the prefix i has a last token p and the pair (p, t) is stable, that is, encoding the bytes of p
and t together gives back exactly p, t. The table of last tokens is filled from left to right, and the encoding is read
backwards. Appending bytes only extends the table, and after an edit only the prefixes behind it are done again.
Texts are first split by the tokenizer's pattern, and each match is encoded separately, as the rank file's library does.

Tables are kept per worker for recurring pieces, in a cache of bounded size; whole texts stream through in slices.
Nulls and edge cases: a null text counts as empty and gives no ids; null ids decode to empty bytes; repeated rows are
encoded row by row; unknown ids raise an error. Text of any language and length is encoded whole. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import give_back, slices, small_batches

CACHE_PIECES = 1 << 17  # in each of two generations
STABLE_PAIRS = 1 << 18
CACHED_BYTES = 64  # longer pieces are encoded each time
_START = -2  # stands before a piece's first token


class Vocabulary:
    """Ranks of byte strings, the greedy merge that defines them, and which pairs of tokens are stable."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.stable: dict[int, dict[int, bool]] = {}  # by the token that follows
        self._known = 0
        self._halves: dict[int, tuple[int, int] | None] = {}  # as many as there are tokens at most
        self._automaton = None

    @classmethod
    def read(cls, content: bytes) -> Vocabulary:
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())})

    def merged(self, piece: bytes) -> list[int]:
        """The encoding by definition: of all neighbours that form a token, the pair of least rank is merged first, leftmost first. For short strings."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens that t is merged from: what is left of its bytes by the merges before it. The token itself twice if it is one byte; None if merging does not lead to it."""
        out = self._halves.get(t, 0)
        if out == 0:
            b = self.bytes_of[t]
            parts = [b[i : i + 1] for i in range(len(b))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank >= t:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            out = (t, t) if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
            self._halves[t] = out
        return out

    def pair(self, p: int, t: int) -> bool:
        """Whether the tokens p, t can stand side by side (p: _START for t at the beginning).

        They can if no merge across the border comes before those that make them. The border's tokens are taken apart from the last merge to the first,
        always the one that was made later, and the two that then meet must not make a token that is merged before what was taken apart last.
        """
        known = self.stable.get(t)
        out = None if known is None else known.get(p)
        if out is None:
            out = self.halves(t) is not None and (p == _START or self._apart(p, t))
            if self._known >= STABLE_PAIRS:
                self.forget()
            self.stable.setdefault(t, {})[p] = out
            self._known += 1
        return out

    def forget(self) -> None:
        self.stable.clear()
        self._known = 0

    def _apart(self, left: int, right: int) -> bool:
        ranks, bytes_of, before = self.ranks, self.bytes_of, 1 << 60
        while True:
            across = ranks.get(bytes_of[left] + bytes_of[right])
            if across is not None and across < before:
                return False
            if left > right:
                before = left
                inner = self.halves(left)
                left = inner[1]
                if left != before:
                    continue
                before, inner = right + 1, self.halves(right)
                if inner[0] == right:
                    return True
                right = inner[0]
            else:
                before = right + 1  # of equal merges the left one comes first
                inner = self.halves(right)
                if inner[0] != right:
                    right = inner[0]
                    continue
                before, inner = left, self.halves(left)
                if inner[1] == left:
                    return True
                left = inner[1]

    def automaton(self):
        """Finds all tokens in a string in one pass (bytes as Latin-1)."""
        if self._automaton is None:
            found = ahocorasick.Automaton()
            for b, t in self.ranks.items():
                found.add_word(b.decode("latin-1"), (t, len(b)))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def fill(self, text: str, last: list[int], at: int = 0) -> None:
        """Sets last[j + 1] for each j >= at of text (bytes as Latin-1) where a token ends; last holds _START where pieces begin."""
        known, pair, none = self.stable.get, self.pair, {}
        for j, (t, size) in self.automaton().iter(text):
            if j < at or last[j + 1] != -1:
                continue
            p = last[j + 1 - size]
            ok = known(t, none).get(p)
            if pair(p, t) if ok is None else ok:
                last[j + 1] = t


class Prefixes:
    """The table of one piece: last[j] is the unique token that ends the encoding of the first j bytes."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [_START]
        self.append(piece)

    def append(self, more: bytes) -> Prefixes:
        """Exact: the table of the longer piece has the present table as its head; only tokens that end in `more` are looked for."""
        start, self.piece = len(self.piece), self.piece + more
        base = max(0, start - self.vocabulary.longest)
        window = self.last[base:] + [-1] * len(more)
        self.vocabulary.fill(self.piece[base:].decode("latin-1"), window, start - base)
        self.last += window[start - base + 1 :]
        return self

    def edit(self, start: int, end: int, new: bytes) -> Prefixes:
        """Replaces bytes start to end. Prefixes before the edit stay; behind it, work stops where the table has come to agree again over a longest token."""
        v, old_piece, old = self.vocabulary, self.piece, self.last
        self.piece, self.last = old_piece[:start], old[: start + 1]
        self.append(new)
        shift, same = len(new) - (end - start), 0
        for k in range(end, len(old_piece)):
            self.append(old_piece[k : k + 1])
            same = same + 1 if self.last[-1] == old[k + 1] and len(v.bytes_of[self.last[-1]]) <= same + 1 else 0
            if same >= 2 * v.longest:  # each later entry depends on the last `longest` entries and on bytes that are the same
                self.piece = self.piece[: k + 1 + shift] + old_piece[k + 1 :]
                self.last += old[k + 2 :]
                break
        return self

    def ids(self) -> list[int]:
        out, j, size = [], len(self.piece), self.vocabulary.bytes_of
        while j:
            out.append(self.last[j])
            j -= len(size[self.last[j]])
        return out[::-1]


class Encoder:
    """Encodes texts piece by piece with a bounded cache; made once in each Python worker."""

    made: dict[tuple[bytes, str], Encoder] = {}

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split, self.cache, self.old = vocabulary, regex.compile(pattern).findall, {}, {}

    @classmethod
    def get(cls, content: bytes, pattern: str) -> Encoder:
        key = (content, pattern)
        if key not in cls.made:
            cls.made.clear()
            cls.made[key] = cls(Vocabulary.read(content), pattern)
        return cls.made[key]

    def rest(self) -> None:
        """At the end of a task: the worker may next do something else, or nothing. The vocabulary and what is known of its pairs, STABLE_PAIRS at most, stay."""
        self.cache, self.old = {}, {}

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of the pieces as 32-bit integers, which the cache does not have; their tables are filled in one pass, side by side."""
        out = {}
        for p in [p for p in pieces if p in self.old]:
            out[p] = self.old[p]
        new = [p for p in pieces if p not in out]
        if new:
            raw_ = [p.encode().decode("latin-1") for p in new]
            ends = np.cumsum([len(r) + 1 for r in raw_]).tolist()
            last = [-1] * (ends[-1] + 1)
            for start in [0, *ends[:-1]]:
                last[start] = _START
            self.vocabulary.fill("\u0100".join(raw_), last)  # no byte has this code: tokens do not cross pieces
            sizes = self.vocabulary.bytes_of
            for p, start, end in zip(new, [0, *ends[:-1]], ends, strict=True):
                ids, j = [], end - 1
                while j > start:
                    t = last[j]
                    ids.append(t)
                    j -= len(sizes[t])
                out[p] = array("i", ids[::-1]).tobytes()
        if len(self.cache) + len(out) > CACHE_PIECES:
            self.old, self.cache = self.cache, {}
        self.cache |= {p: x for p, x in out.items() if len(p) <= CACHED_BYTES}
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, np.int32).tolist() for x in self.packed(texts)]

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        pieces = [self.split(t) if t else [] for t in texts]
        cache = self.cache
        new = self.learn(list(dict.fromkeys([p for own in pieces for p in own if p not in cache])))
        get = cache.get  # also after a change of generations: what is not in the one before is among the new ones
        return [b"".join([get(p) or new[p] for p in own]) for own in pieces]

    def append(self, text: str, ids: list[int], more: str) -> list[int]:
        """Ids of text + more from those of text: pieces are settled up to the last run of spaces before the end and are kept as they are."""
        found = [m.span() for m in regex.finditer(self.split.__self__.pattern, text)]
        keep = next((k for k in range(len(found) - 1, 0, -1) if not text[found[k - 1][0] : found[k][0]].isspace() and not text[found[k][0] :].isspace()), 0)
        at = found[keep][0] if found else 0
        n, kept = len(text[:at].encode()), 0
        size = self.vocabulary.bytes_of
        while n:
            n -= len(size[ids[kept]])
            kept += 1
        return ids[:kept] + self.encode(text[at:] + more)


def _content(spark, vocabulary: str):
    """The rank file, read on the driver; its fixed-size content goes to the executors."""
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _table(content: bytes) -> list[bytes | None]:
    by_id = {int(b): base64.b64decode(a) for a, b in (line.split() for line in content.splitlines() if line.strip())}
    return [by_id.get(i) for i in range(max(by_id, default=-1) + 1)]


def _decoded(table: list[bytes | None] | dict[int, bytes], flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of each list of ids. ends: where the lists begin and end in flat."""
    flat = flat.tolist()
    return pa.array([b"".join([table[i] for i in flat[a:b]]) for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)], pa.binary())


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", out_col: str = "ids", keep: list[str] | None = None, decoded_col: str | None = None) -> DataFrame:
    """The columns in keep (all by default) and out_col: array of token ids. vocabulary: path of a rank file on the driver.

    decoded_col: also decodes the ids, in the same pass and the same worker, into a column of bytes.
    """
    small_batches(docs.sparkSession)
    content = _content(docs.sparkSession, vocabulary)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (out_col, decoded_col)]  # columns of these names are replaced
    more = [T.StructField(decoded_col, T.BinaryType())] if decoded_col else []
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out_col, T.ArrayType(T.IntegerType())), *more])
    columns = list(dict.fromkeys([*keep, text_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(content.value, pattern)
        table = encoder.vocabulary.bytes_of
        for batch in slices(batches, text_col, 1 << 20):
            found = encoder.packed(batch.column(columns.index(text_col)).to_pylist())
            ends = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in found], out=ends[1:])
            flat = np.frombuffer(b"".join(found), np.int32)
            del found
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            back = [_decoded(table, flat, ends)] if decoded_col else []
            yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in keep), ids, *back], names=[f.name for f in schema])
            del batch, ids, back, flat, ends
        encoder.rest()
        give_back()

    return docs.select(*columns).mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns and out_col: the bytes that the ids stand for."""
    small_batches(tokens.sparkSession)
    content = _content(tokens.sparkSession, vocabulary)
    schema = T.StructType([*tokens.schema.fields, T.StructField(out_col, T.BinaryType())])
    at = tokens.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(content.value)
        for batch in batches:
            for part in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
                col = part.column(at)
                sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
                out = _decoded(table, col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]))
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[f.name for f in schema])

    return tokens.mapInArrow(run, schema)
