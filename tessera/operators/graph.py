"""Prerequisite graphs: edge hygiene by rows, cycle breaking and priority order by graph.

A graph is the topics of one subject or one user, which a curriculum bounds; the two sequential algorithms run once for each graph,
spread over the cluster by it.
"""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written


def first_wins(rows: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    """The row of least ordinal for each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_r = 1").drop("_r")


def parsed_edges(raw: DataFrame) -> DataFrame:
    """raw(subject, topic_key, prerequisite_key, confidence string, ordinal): keys folded, no self loops, the first of a pair, confidence from 0 to 1 (0 if it is no number)."""
    fold = lambda c: F.lower(F.trim(c)).alias(c)
    rows = raw.select("subject", fold("topic_key"), fold("prerequisite_key"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)))).alias("confidence"), "ordinal")
    return first_wins(rows.filter("topic_key <> prerequisite_key and topic_key <> '' and prerequisite_key <> ''"), ["subject", "topic_key", "prerequisite_key"])


def filtered_edges(edges: DataFrame, nodes: DataFrame, least: float = 0.7) -> DataFrame:
    """First of each pair, and only then: known ends, no self loop, confidence of `least` or more."""
    known = nodes.select("subject", "topic_key").distinct()
    kept = first_wins(edges, ["subject", "topic_key", "prerequisite_key"]).filter((F.col("topic_key") != F.col("prerequisite_key")) & (F.col("confidence") >= least))
    kept = kept.join(known, ["subject", "topic_key"], "left_semi")
    return kept.join(known.withColumnRenamed("topic_key", "prerequisite_key"), ["subject", "prerequisite_key"], "left_semi")


def decided(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Without the edges whose last decision is drop; no decision keeps."""
    last = decisions.groupBy("subject", "topic_key", "prerequisite_key").agg(F.max_by("decision", "ordinal").alias("decision"))
    return edges.join(last, ["subject", "topic_key", "prerequisite_key"], "left").filter(F.coalesce("decision", F.lit("keep")) != "drop").drop("decision")


def _cycle(after: dict[str, list[str]]) -> list[str] | None:
    """Nodes of a cycle, found depth first in sorted order without recursion; None if there is none."""
    done: set[str] = set()
    for start in sorted(after):
        if start in done:
            continue
        path, on, todo = [start], {start}, [iter(sorted(after.get(start, ())))]
        while todo:
            nxt = next(todo[-1], None)
            if nxt is None:
                todo.pop()
                on.discard(path[-1])
                done.add(path.pop())
            elif nxt in on:
                return path[path.index(nxt) :]
            elif nxt not in done:
                path.append(nxt)
                on.add(nxt)
                todo.append(iter(sorted(after.get(nxt, ()))))
    return None


def break_cycles(edges: DataFrame) -> DataFrame:
    """edges with `dropped`: as long as a subject has a cycle, its edge of least (confidence, topic, prerequisite) is taken out."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        alive = {(r.prerequisite_key, r.topic_key): r.confidence for r in rows.itertuples()}
        while True:
            after: dict[str, list[str]] = {}
            for a, b in alive:
                after.setdefault(a, []).append(b)
            found = _cycle(after)
            if found is None:
                break
            ring = set(zip(found, [*found[1:], found[0]], strict=True))
            del alive[min((e for e in alive if e in ring), key=lambda e: (alive[e], e[1], e[0]))]
        return rows.assign(dropped=[(r.prerequisite_key, r.topic_key) not in alive for r in rows.itertuples()])

    return edges.groupBy("subject").applyInPandas(run, T.StructType([*edges.schema.fields, T.StructField("dropped", T.BooleanType())]))


def priority_order(nodes: DataFrame, edges: DataFrame, graph: str = "graph") -> DataFrame:
    """nodes(graph, topic_key, priority), edges(graph, topic_key, prerequisite_key) -> (graph, topic_key, position, in_cycle).

    Topological order in which the ready node of highest priority comes first (ties by key); nodes on or behind a cycle follow by priority.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rank = {k: (-p, k) for k, p in zip(left["topic_key"], left["priority"], strict=True)}
        pairs = {(a, b) for a, b in zip(right["prerequisite_key"], right["topic_key"], strict=True) if a in rank and b in rank and a != b}
        after, waits = {}, dict.fromkeys(rank, 0)
        for a, b in pairs:
            after.setdefault(a, []).append(b)
            waits[b] += 1
        heap, out = [rank[k] for k in rank if not waits[k]], []
        heapq.heapify(heap)
        while heap:
            k = heapq.heappop(heap)[1]
            out.append(k)
            for b in after.get(k, ()):
                waits[b] -= 1
                if not waits[b]:
                    heapq.heappush(heap, rank[b])
        ring = sorted((rank[k] for k in rank if waits[k]))
        order = out + [k for _, k in ring]
        return pd.DataFrame({graph: [key[0]] * len(order), "topic_key": order, "position": range(1, len(order) + 1), "in_cycle": [False] * len(out) + [True] * len(ring)})

    schema = nodes.select(graph, "topic_key").schema.add("position", "long").add("in_cycle", "boolean")
    return nodes.groupBy(graph).cogroup(edges.groupBy(graph)).applyInPandas(run, schema)


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(subject, node, targets): each node's topics, sorted; nodes without any are included."""
    out = edges.groupBy("subject", F.col("prerequisite_key").alias("node")).agg(F.array_sort(F.collect_set("topic_key")).alias("targets"))
    every = nodes.select("subject", F.col("topic_key").alias("node")).distinct()
    return every.join(out, ["subject", "node"], "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))


def connected(pairs: DataFrame) -> DataFrame:
    """pairs(a, b) -> (node, root): the smallest node that can be reached. A round takes the least root among the neighbours, then the root's root."""
    edges = written(pairs.select("a", "b").union(pairs.select("b", "a")).filter("a <> b").distinct())
    now = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = edges.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        told = now.join(near, "node").select("node", "root", F.least("root", "near").alias("to"))
        above = now.select(F.col("node").alias("to"), F.col("root").alias("up"))
        after = written(told.join(above, "to").select("node", F.least("to", "up").alias("root"), (F.least("to", "up") < F.col("root")).alias("moved")))
        now = after.select("node", "root")
        if after.filter("moved").isEmpty():
            return now


def _rooted(single: DataFrame) -> DataFrame:
    """single(subject, node, up, d): nodes with one prerequisite -> the same with `up` the first node above that is none of these, and its distance.

    Pointers double: each round looks as far again as the one before. Nodes of a ring, and what hangs below one, are left out.
    """
    now, nodes = written(single), single.count()
    for _ in range(nodes.bit_length() + 1):
        above = now.select("subject", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        longer = now.join(above, ["subject", "up"], "left").select("subject", "node", F.coalesce("up2", "up").alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), F.col("up2").isNotNull().alias("moved"))
        now = written(longer)
        if now.filter("moved").isEmpty():
            break
        now = now.drop("moved")
    return now.select("subject", "node", "up", "d").join(single.select("subject", F.col("node").alias("up")), ["subject", "up"], "left_anti")


def depths(edges: DataFrame) -> DataFrame:
    """(subject, node, depth): the longest chain of prerequisites below each node; null for nodes on a cycle or behind one.

    Nodes with one prerequisite hang on it, so chains are settled by doubling pointers, in as many rounds as their length has bits. What is
    left is settled level by level: a node is when all its prerequisites are, and it keeps one number, the greatest so far. Every edge is
    followed once; a round writes the nodes that still wait. The levels end where nothing more is settled.
    """
    e = written(edges.select("subject", F.col("topic_key").alias("node"), F.col("prerequisite_key").alias("pre")).distinct())
    needs = e.groupBy("subject", "node").agg(F.count("*").alias("needs"), F.min("pre").alias("pre"))
    hung = written(_rooted(needs.filter("needs = 1").select("subject", "node", F.col("pre").alias("up"), F.lit(1).cast("long").alias("d"))))
    many = needs.filter("needs > 1").select("subject", "node")
    at = hung.select("subject", F.col("node").alias("pre"), "up", "d")
    short = e.join(many, ["subject", "node"], "left_semi").join(at, ["subject", "pre"], "left")
    short = written(short.groupBy("subject", "node", F.coalesce("up", "pre").alias("pre")).agg((F.max(F.coalesce("d", F.lit(0))) + 1).alias("w")))  # of several ways to one node, the longest
    every = written(e.select("subject", "node").union(e.select("subject", "pre")).distinct())
    fresh = written(every.join(e.select("subject", "node").distinct(), ["subject", "node"], "left_anti").withColumn("depth", F.lit(0).cast("long")))
    waits = written(short.groupBy("subject", "node").agg(F.count("*").alias("left"), F.lit(0).cast("long").alias("best")))
    done = [fresh]
    while not waits.isEmpty() and not fresh.isEmpty():
        told = short.join(fresh.select("subject", F.col("node").alias("pre"), "depth"), ["subject", "pre"]).groupBy("subject", "node").agg(F.count("*").alias("n"), F.max(F.col("depth") + F.col("w")).alias("far"))
        state = written(waits.join(told, ["subject", "node"], "left").select("subject", "node", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"), F.greatest("best", F.coalesce("far", F.lit(0))).alias("best")))
        fresh, waits = state.filter("left = 0").select("subject", "node", F.col("best").alias("depth")), state.filter("left > 0")
        done.append(fresh)
        if len(done) >= 16:
            done = [written(reduce(DataFrame.unionByName, done))]
    roots = reduce(DataFrame.unionByName, done)
    below = hung.join(roots.select("subject", F.col("node").alias("up"), "depth"), ["subject", "up"]).select("subject", "node", (F.col("depth") + F.col("d")).alias("depth"))
    return every.join(roots.unionByName(below), ["subject", "node"], "left").select("subject", "node", F.col("depth").cast("int").alias("depth"))
