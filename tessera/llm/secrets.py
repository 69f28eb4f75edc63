"""Secret scans by a trigram inverted index.

Each rule's regex gives a Boolean query over trigrams that every match must contain (an AND of ORs of ANDs, worked out
from the pattern itself). For each block of documents the postings of just those trigrams are built from the bytes, the
query is answered by intersecting and uniting postings, and only the candidates are verified by the regex. A rule whose
regex has no mandatory trigram scans every document of the block. Blocks follow the text's volume, so memory is bounded
for any text length, and no index row is shuffled: postings are used where they are built.

Nulls and edge cases: a null text counts as empty; no match gives empty arrays; spans are in code points, end exclusive;
repeated rows and ids are scanned row by row; other columns are not read and cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

try:  # the parser of the standard library's own regex engine
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # pragma: no cover
    import sre_constants as sre
    import sre_parse

from .common import raw, slices, small_batches


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and do not overlap; one is dropped if its `group` has fewer than `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The three base rules, in the order in which they are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, True),
)
#: Further well-known public token formats.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}=*"),
)
RULES = BASE_RULES + MORE_RULES

#: A query: True (every text may match), or ("and" | "or", parts), or a trigram of lower-case bytes.
Query = object


def _all(parts: list) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list) -> Query:
    return True if not parts or any(p is True for p in parts) else parts[0] if len(set(parts)) == 1 else ("or", tuple(dict.fromkeys(parts)))


def _trigrams(text: bytes) -> Query:
    return _all([text[i : i + 3] for i in range(len(text) - 2)])


@dataclass
class _Seen:
    """What is known of a part of a regex: all its strings if they are few (exact), else a query that its matches satisfy."""

    exact: set[bytes] | None = None
    query: Query = field(default=True)

    def asked(self) -> Query:
        return self.query if self.exact is None else _any([_trigrams(x) for x in sorted(self.exact)])


def _letters(op, arg) -> set[bytes] | None:
    if op is sre.LITERAL:
        return {chr(arg).lower().encode()} if arg < 128 else None
    if op is sre.IN:
        out = set()
        for kind, x in arg:
            if kind is sre.LITERAL and x < 128:
                out.add(chr(x).lower().encode())
            elif kind is sre.RANGE and x[1] < 128 and x[1] - x[0] < 4:
                out |= {chr(c).lower().encode() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    return None


def _seen(parts) -> _Seen:
    """A sequence: runs of exact strings are multiplied out, and each run that ends is turned into its query."""
    run, asked = {b""}, []

    def end() -> None:
        nonlocal run
        asked.append(_Seen(run).asked())
        run = {b""}

    for op, arg in parts:
        if (own := _letters(op, arg)) is not None:
            one = _Seen(own)
        elif op is sre.SUBPATTERN:
            one = _seen(arg[3])
        elif op is sre.BRANCH:
            ways = [_seen(x) for x in arg[1]]
            one = _Seen(set().union(*(w.exact for w in ways))) if all(w.exact is not None for w in ways) else _Seen(None, _any([w.asked() for w in ways]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, getattr(sre, "POSSESSIVE_REPEAT", None)):
            least, most, body = arg
            inner = _seen(body)
            if inner.exact is not None and int(most) <= 4 and len(inner.exact) ** int(most) <= 32:
                strings, power = set(), {b""}
                for k in range(int(most) + 1):
                    strings |= power if k >= least else set()
                    power = {a + b for a in power for b in inner.exact}
                one = _Seen(strings)
            else:
                one = _Seen(None, inner.asked() if least else True)
                if inner.exact is not None and least and len(inner.exact) ** least <= 32:
                    for _ in range(least):
                        run = {a + b for a in run for b in inner.exact}
        elif op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
            continue
        else:
            one = _Seen(None, True)
        if one.exact is not None and len(run) * len(one.exact) <= 64:
            run = {a + b for a in run for b in one.exact}
        else:
            end()
            if one.exact is not None:
                run = one.exact
            else:
                asked.append(one.query)
    if not asked:
        return _Seen(run)
    end()
    return _Seen(None, _all(asked))


def trigram_query(pattern: str) -> Query:
    """A necessary condition of a match, over trigrams of ASCII-lower-cased bytes; True if the pattern has none."""
    return _seen(sre_parse.parse(pattern)).asked()


def _needed(query: Query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(_needed, query[1]))


def _answer(query: Query, postings: dict[bytes, np.ndarray], every: np.ndarray) -> np.ndarray:
    if query is True:
        return every
    if isinstance(query, bytes):
        return postings[query]
    lists = sorted((_answer(q, postings, every) for q in query[1]), key=len)
    out = lists[0]
    for x in lists[1:]:
        out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def block_postings(data: np.ndarray, offsets: np.ndarray, trigrams: list[bytes]) -> dict[bytes, np.ndarray]:
    """For each trigram, the sorted numbers of the texts that hold it (in any ASCII case)."""
    none = np.zeros(0, np.int64)
    if len(data) < 3:
        return dict.fromkeys(trigrams, none)
    low = _LOWER[data]
    wanted = np.zeros((3, 256), bool)
    for t in trigrams:
        wanted[np.arange(3), list(t)] = True
    at = np.flatnonzero(wanted[0][low[:-2]] & wanted[1][low[1:-1]] & wanted[2][low[2:]])
    code = (low[at].astype(np.int32) << 16) | (low[at + 1].astype(np.int32) << 8) | low[at + 2]
    of = np.searchsorted(offsets, at, side="right") - 1
    inside = at + 3 <= offsets[of + 1]
    code, of = code[inside], of[inside]
    return {t: np.unique(of[code == int.from_bytes(t, "big")]) for t in trigrams}


def _found(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    if rule.least:
        return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return [m.span() for m in compiled.finditer(text)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, secrets: array of (kind, start, end)), by start and then in the order of the rules."""
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([docs.schema[id_col], T.StructField("secrets", T.ArrayType(item))])
    small_batches(docs.sparkSession)
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted(set().union(*map(_needed, queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a run of a character class alone is found faster with its least length; the matches are the same maximal runs
        compiled = [re.compile(r.pattern[:-1] + f"{{{r.least},}}" if re.fullmatch(r"\[[^\]]+\]\+", r.pattern) and r.least and not r.group else r.pattern, re.ASCII) for r in rules]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in slices(batches, text_col):
            data, offsets = raw(batch.column(1))
            postings, every = block_postings(data, offsets, trigrams), np.arange(batch.num_rows)
            found: list[list] = [[] for _ in range(batch.num_rows)]
            texts: dict[int, str] = {}
            body = data.tobytes()
            for n, (rule, query, regex) in enumerate(zip(rules, queries, compiled, strict=True)):
                for i in _answer(query, postings, every).tolist():
                    if i not in texts:
                        texts[i] = body[offsets[i] : offsets[i + 1]].decode()
                    found[i] += [(a, n, b) for a, b in _found(rule, regex, texts[i])]
            rows = [[{"kind": rules[n].kind, "start": a, "end": b} for a, n, b in sorted(x)] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], names=[id_col, "secrets"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
