"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that they belong to). A flow routes the patterns' tokens
to the sources' quotas; the first pass over a pattern is free and each further one costs more (convex repetition costs),
so repetition is used only where quotas cannot be met otherwise. A source whose documents belong to no other needs no network:
its one pattern meets its quota as far as the passes go. The network of the others has one node for each pattern and
source and is worked out on the driver: at most MAX_PATTERNS of these overlapping patterns, an error beyond. Inside a pattern every document is taken in whole passes, and
the rest of the pattern's flow goes to documents in a seeded order, up to the rest, and then to a few further documents that close
the remaining gap.

The seeded order is not sorted as a whole: sums by 4,096 ranges of the order's hash locate the cut, and only the range that
holds the cut is ordered. Reruns agree, as orders depend on ids alone.

Nulls and edge cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0
are taken 0 words; a null id sorts as an empty one; rows that repeat an id stand or fall together; documents without any source are not taken;
other columns pass through `repeated`. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

#: Patterns of sources that overlap that the flow on the driver takes; more raise an error.
MAX_PATTERNS = 20_000
#: Rows of a plan that are broadcast; a longer one is joined by a shuffle.
FEW_PATTERNS = 50_000
GAP_ROUNDS = 8
_PICKS = "array<struct<_order:long,_key:string>>"
WEIGHTS = (3, 1, 2)


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    weight: int
    target: float


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> list[Source]:
    """Shares of share[0]/share[1] of all sizes by weight; none above `most` times its source's size, the excess reshared."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    whole, capped, left, level = sum(sizes.values()), 0, sum(weight.values()), 0.0
    for s in sorted(names, key=lambda s: most * sizes[s] / weight[s]):
        level = (share[0] * whole - share[1] * capped) / (share[1] * left)  # what a unit of weight gets if s and those after it are not capped
        if level <= most * sizes[s] / weight[s]:
            break
        capped, left = capped + most * sizes[s], left - weight[s]
    return [Source(s, sizes[s], weight[s], float(min(most * sizes[s], level * weight[s]))) for s in names]


def flow(patterns: dict[tuple, int], quotas: dict, most: int = 2) -> dict[tuple, dict]:
    """Words from each pattern to each of its sources: as much of the quotas as can be met, at least cost, where the k-th pass costs k - 1 a word."""
    shared = Counter(s for p in patterns for s in p)
    alone = {p: {p[0]: min(quotas[p[0]], most * size)} for p, size in patterns.items() if len(p) == 1 and shared[p[0]] == 1 and p[0] in quotas}
    if alone:
        rest = {p: size for p, size in patterns.items() if p not in alone}
        return alone | (flow(rest, {s: q for s, q in quotas.items() if (s,) not in alone}, most) if rest else {})
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"{len(patterns)} overlapping patterns of membership, over {MAX_PATTERNS}: join sources into groups first")
    names = ["from", "to", *(("p", p) for p in patterns), *(("s", s) for s in quotas)]
    at = {n: i for i, n in enumerate(names)}
    edges: list[list[int]] = []  # to, capacity, cost; the reverse edge is at index ^ 1
    out: list[list[int]] = [[] for _ in names]

    def edge(a, b, capacity: int, cost: int) -> int:
        out[at[a]].append(len(edges))
        edges.append([at[b], capacity, cost])
        out[at[b]].append(len(edges))
        edges.append([at[a], 0, -cost])
        return len(edges) - 2

    for p, size in patterns.items():
        for k in range(most):
            edge("from", ("p", p), size, k)
    ways = {(p, s): edge(("p", p), ("s", s), most * size, 0) for p, size in patterns.items() for s in p if s in quotas}
    for s, quota in quotas.items():
        edge(("s", s), "to", quota, 0)
    potential = [0] * len(names)
    while True:  # successive shortest paths
        far, via, heap = [1 << 60] * len(names), [-1] * len(names), [(0, 0)]
        far[0] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in out[u]:
                v, capacity, cost = edges[e]
                if capacity and d + cost + potential[u] - potential[v] < far[v]:
                    far[v], via[v] = d + cost + potential[u] - potential[v], e
                    heapq.heappush(heap, (far[v], v))
        if via[1] < 0:
            return {p: {s: edges[ways[p, s] ^ 1][1] for s in p if (p, s) in ways} for p in patterns}
        potential = [h + f if f < 1 << 60 else h for h, f in zip(potential, far, strict=True)]
        path, v = [], 1
        while v:
            path.append(via[v])
            v = edges[via[v] ^ 1][0]
        step = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= step
            edges[e ^ 1][1] += step


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW_PATTERNS else df


class Mix:
    """A mixture that has been worked out. sources: its targets; cuts: for each pattern, whole passes and where the seeded order is cut."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", members: Column | None = None, seed: int = 7, most: int = 2):
        """members: array of a document's sources; the column `source` alone by default."""
        spark = docs.sparkSession
        self.id_col, self.most = id_col, most
        self.columns = {
            "_pattern": F.to_json(F.array_sort(F.array_distinct(F.array(F.col("source").cast("string")) if members is None else members.cast("array<string>")))),
            "_size": F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.regexp_count(F.col(text_col), F.lit(WORD))).cast("long"),
            "_key": F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        }
        self.columns["_order"] = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), self.columns["_key"])), 1, 15), 16, 10).cast("long")
        scratch = Scratch(spark)
        self.rows = rows = scratch.table(docs.select(F.col(id_col).alias("_id"), *(c.alias(n) for n, c in self.columns.items())), "sizes")
        ranges = rows.groupBy("_pattern", F.shiftright("_order", 48).alias("_range")).agg(F.sum("_size").alias("words"))
        ranges = scratch.table(ranges, "ranges")
        found = {tuple(json.loads(r[0])): r for r in ranges.groupBy("_pattern").agg(F.sum("words")).collect()}
        patterns = {p: r[1] for p, r in found.items()}
        sizes: dict[str | None, int] = {}
        for p, size in patterns.items():
            for s in p:
                sizes[s] = sizes.get(s, 0) + size
        self.sources = targets(sizes, most=most)
        routed = flow(patterns, {s.name: int(s.target + 0.5) for s in self.sources}, most)
        plan = []
        for p, size in patterns.items():
            words = sum(routed[p].values())
            passes = words // size if size else 0
            plan.append((found[p]["_pattern"], passes, words - passes * size))
        wanted = _few(spark.createDataFrame(plan, "_pattern string, _passes long, _rest long"), len(plan))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("_pattern").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cut = ranges.withColumn("before", before).join(wanted, "_pattern").filter("_rest > 0 and before <= _rest and before + words > _rest").select("_pattern", "_range", "before", "_rest")
        inside = rows.withColumn("_range", F.shiftright("_order", 48)).join(_few(cut, len(plan)), ["_pattern", "_range"])
        order = Window.partitionBy("_pattern").orderBy("_order", "_key", "_size")
        inside = inside.withColumn("total", F.col("before") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        # the last document that fits as a whole: order and key of the cut, and what is still missing there
        fits = inside.groupBy("_pattern").agg(
            F.max(F.when(F.col("total") <= F.col("_rest"), F.struct("_order", "_key"))).alias("last"),
            F.min("_range").alias("range"),
            F.max("_rest").alias("rest"),
            F.coalesce(F.max(F.when(F.col("total") <= F.col("_rest"), F.col("total"))), F.max("before")).alias("got"),
        )
        cuts = fits.select("_pattern", F.coalesce("last", F.struct((F.shiftleft("range", 48) - 1).alias("_order"), F.lit("").alias("_key"))).alias("last"), (F.col("rest") - F.col("got")).alias("gap"))
        cuts = scratch.table(cuts, "cuts")  # one row for each pattern
        # up to GAP_ROUNDS further documents: the largest that fits, again and again, and at last the one that comes closest
        state = {r["_pattern"]: {"last": (r["last"]["_order"], r["last"]["_key"]), "gap": r["gap"], "more": []} for r in cuts.collect()}
        for k in range(GAP_ROUNDS):
            open_ = [(p, x["gap"], *x["last"], x["more"]) for p, x in state.items() if x["gap"] > 0]
            if not open_:
                break
            asked = _few(spark.createDataFrame(open_, f"_pattern string, _gap long, _cut long, _cut_key string, _more {_PICKS}"), len(open_))
            key = F.struct("_order", "_key")
            left = rows.join(asked, "_pattern").filter((key > F.struct(F.col("_cut").alias("_order"), F.col("_cut_key").alias("_key"))) & ~F.array_contains("_more", key) & (F.col("_size") > 0))
            if k < GAP_ROUNDS - 1:
                left, off = left.filter("_size <= _gap"), -F.col("_size")
            else:
                left, off = left.filter("_size < 2 * _gap"), F.abs(F.col("_size") - F.col("_gap"))
            for r in left.groupBy("_pattern").agg(F.min(F.struct(off.alias("off"), F.col("_order"), F.col("_key"), F.col("_size"))).alias("m")).collect():
                state[r["_pattern"]]["gap"] -= r["m"]["_size"]
                state[r["_pattern"]]["more"].append((r["m"]["_order"], r["m"]["_key"]))
        none = {"last": (-1, ""), "more": []}
        self.cuts = [(p, passes, *state.get(p, none)["last"], state.get(p, none)["more"]) for p, passes, _ in plan]
        self.spark = spark

    def with_taken(self, rows: DataFrame) -> DataFrame:
        """rows that have the working columns, and _taken: how many times each is taken as a whole."""
        cuts = _few(self.spark.createDataFrame(self.cuts, f"_pattern string, _passes long, _cut long, _cut_key string, _more {_PICKS}"), len(self.cuts))
        key = F.struct("_order", "_key")
        chosen = (key <= F.struct(F.col("_cut").alias("_order"), F.col("_cut_key").alias("_key"))) | F.array_contains("_more", key)
        times = F.least(F.col("_passes") + chosen.cast("long"), F.lit(self.most))
        return rows.join(cuts, "_pattern").withColumn("_taken", times).drop("_passes", "_cut", "_cut_key", "_more")

    def taken(self) -> DataFrame:
        """(id, pattern, size, taken): the words that the mix takes of each document, repeats counted."""
        return self.with_taken(self.rows).select(F.col("_id").alias(self.id_col), F.col("_pattern").alias("pattern"), F.col("_size").alias("size"), (F.col("_size") * F.col("_taken")).alias("taken"))

    def repeated(self, docs: DataFrame) -> DataFrame:
        """The mixed documents: each row as many times as it is taken. Decided where the texts are read, without a shuffle."""
        row = F.struct(*docs.columns).alias("_row")  # one column, so that no name of docs can clash
        rows = docs.select(row, *(c.alias(n) for n, c in self.columns.items()))
        taken = self.with_taken(rows).filter("_taken > 0 and _size > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_taken"))))
        return taken.select(*(F.col("_row")[c].alias(c) for c in docs.columns))
