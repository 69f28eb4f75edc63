"""Graph queries: nations as topics of their region's graph, with arithmetic edges that include faults and back edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources import relations as S
from .registry import query

# every nation needs the ones one and two places on in its region; odd keys, doubled pairs, self loops and unreadable confidences occur
NODES_SQL = "nodes as (select r.r_name subject, 't' || lpad(n_nationkey::varchar, 2, '0') topic_key, (n_nationkey * 37 % 11)::double priority from nation join region r on r.r_regionkey = n_regionkey)"
RAW_SQL = """raw as (select r_name subject, case when n.n_nationkey % 3 = 0 then ' T' else 't' end || lpad(n.n_nationkey::varchar, 2, '0') topic_key, 't' || lpad((n.n_nationkey + d.d)::varchar, 2, '0') prerequisite_key,
  case when (n.n_nationkey + d.d) % 7 = 0 then 'bad' else ((50 + (n.n_nationkey * 13 + d.d * 29) % 70) / 100.0::double)::varchar end confidence, (n.n_nationkey * 10 + d.o)::bigint ordinal
  from nation n join region r on r.r_regionkey = n.n_regionkey, (values (1, 0), (2, 1), (1, 2), (0, 3), (-3, 4), (5, 5)) d(d, o))"""
EDGES_SQL = f"""{NODES_SQL}, {RAW_SQL}, pe0 as (select subject, lower(trim(topic_key)) topic_key, lower(trim(prerequisite_key)) prerequisite_key, greatest(0.0::double, least(1.0::double, coalesce(try_cast(confidence as double), 0.0::double))) confidence, ordinal from raw),
  pe as (select * from pe0 where topic_key <> prerequisite_key qualify row_number() over (partition by subject, topic_key, prerequisite_key order by ordinal) = 1),
  fe as (select * from pe where confidence >= 0.55 and exists (select 1 from nodes n where n.subject = pe.subject and n.topic_key = pe.topic_key) and exists (select 1 from nodes n where n.subject = pe.subject and n.topic_key = pe.prerequisite_key)),
  dag as (select * from fe where prerequisite_key > topic_key)"""


def _nodes(spark, sf):
    n, r = S.table(spark, sf, "nation"), S.table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("subject"))
    key = F.concat(F.lit("t"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    return n.join(r, "n_regionkey").select("subject", key.alias("topic_key"), (F.col("n_nationkey") * 37 % 11).cast("double").alias("priority"), "n_nationkey")


def _raw(spark, sf):
    n = F.col("n_nationkey").cast("int")
    steps = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(o).alias("o")) for d, o in ((1, 0), (2, 1), (1, 2), (0, 3), (-3, 4), (5, 5))))
    rows = _nodes(spark, sf).select("subject", n.alias("n"), F.explode(steps).alias("s"))
    to = F.col("n") + F.col("s.d")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    confidence = F.when(F.pmod(to, F.lit(7)) == 0, F.lit("bad")).otherwise(((50 + (F.col("n") * 13 + F.col("s.d") * 29) % 70) / 100).cast("string"))
    return rows.select("subject", F.concat(F.when(F.col("n") % 3 == 0, F.lit(" T")).otherwise(F.lit("t")), two(F.col("n"))).alias("topic_key"), F.concat(F.lit("t"), two(to)).alias("prerequisite_key"), confidence.alias("confidence"), (F.col("n") * 10 + F.col("s.o")).cast("long").alias("ordinal"))


def _edges(spark, sf):
    return G.filtered_edges(G.parsed_edges(_raw(spark, sf)), _nodes(spark, sf), 0.55)


@query("M1_parse_edges", f"with {EDGES_SQL} select subject, topic_key, prerequisite_key, round(confidence, 6) confidence from pe")
def _(spark, sf):
    return G.parsed_edges(_raw(spark, sf)).select("subject", "topic_key", "prerequisite_key", F.round("confidence", 6).alias("confidence"))


@query("F13_first_wins", f"with {EDGES_SQL} select subject, topic_key, prerequisite_key, ordinal from raw qualify row_number() over (partition by subject, topic_key, prerequisite_key order by ordinal) = 1")
def _(spark, sf):
    return G.first_wins(_raw(spark, sf), ["subject", "topic_key", "prerequisite_key"]).select("subject", "topic_key", "prerequisite_key", "ordinal")


@query("M2_parse_topics", f"with {NODES_SQL} select subject, topic_key, 'Nation ' || upper(topic_key[1:1]) || topic_key[2:] display_name from nodes")
def _(spark, sf):
    return _nodes(spark, sf).select("subject", "topic_key", F.concat(F.lit("Nation "), F.initcap("topic_key")).alias("display_name"))


@query("M3_filter_edges", f"with {EDGES_SQL} select subject, topic_key, prerequisite_key from fe")
def _(spark, sf):
    return _edges(spark, sf).select("subject", "topic_key", "prerequisite_key")


@query("C7_edge_endpoint_semi_join", f"with {EDGES_SQL} select subject, count(*) n from fe group by subject")
def _(spark, sf):
    return _edges(spark, sf).groupBy("subject").agg(F.count("*").alias("n"))


@query("M4_edge_decisions", f"with {EDGES_SQL}, dec as (select subject, topic_key, prerequisite_key, max_by(case when ordinal % 4 = 0 then 'drop' else 'keep' end, ordinal) dec from pe0 where ordinal % 3 <> 1 group by all) select subject, topic_key, prerequisite_key from fe left join dec using (subject, topic_key, prerequisite_key) where coalesce(dec, 'keep') <> 'drop'")
def _(spark, sf):
    decisions = _raw(spark, sf).filter("ordinal % 3 <> 1").select("subject", F.lower(F.trim("topic_key")).alias("topic_key"), F.lower(F.trim("prerequisite_key")).alias("prerequisite_key"), F.when(F.col("ordinal") % 4 == 0, F.lit("drop")).otherwise(F.lit("keep")).alias("decision"), "ordinal")
    return G.decided(_edges(spark, sf), decisions).select("subject", "topic_key", "prerequisite_key")


@query("M5_break_cycles")
def _(spark, sf):
    return G.break_cycles(_edges(spark, sf)).select("subject", "topic_key", "prerequisite_key", "dropped")


@query("M6_priority_order", f"""with recursive {EDGES_SQL}, ns as (select subject, list({{'k': topic_key, 'p': priority}}) ns from nodes group by subject), es as (select subject, list({{'a': prerequisite_key, 'b': topic_key}}) es from dag group by subject),
  st as (select subject, ns, coalesce(es, []) es, []::varchar[] done from ns left join es using (subject) union all
  select subject, ns, es, list_append(done, list_sort(list_transform(list_filter(ns, lambda n: not list_contains(done, n.k) and len(list_filter(es, lambda e: e.b = n.k and not list_contains(done, e.a))) = 0), lambda n: {{'p': -n.p, 'k': n.k}}))[1].k) from st where len(done) < len(ns))
  select subject graph, unnest(done) topic_key, generate_subscripts(done, 1) as position from st where len(done) = len(ns)""")
def _(spark, sf):
    nodes = _nodes(spark, sf).select(F.col("subject").alias("graph"), "topic_key", "priority")
    edges = _edges(spark, sf).filter("prerequisite_key > topic_key").select(F.col("subject").alias("graph"), "topic_key", "prerequisite_key")
    return G.priority_order(nodes, edges).select("graph", "topic_key", "position")


@query("M7_learning_path")
def _(spark, sf):
    nodes = _nodes(spark, sf).select(F.col("subject").alias("graph"), "topic_key", "priority")
    edges = _edges(spark, sf)
    needs = edges.groupBy(F.col("subject").alias("graph"), "topic_key").agg(F.array_join(F.array_sort(F.collect_set("prerequisite_key")), ",").alias("prerequisites"))
    return G.priority_order(nodes, edges.withColumnRenamed("subject", "graph")).join(needs, ["graph", "topic_key"], "left").select("graph", "topic_key", "position", "in_cycle", F.coalesce("prerequisites", F.lit("")).alias("prerequisites"))


@query("O4_path_projection", f"with {EDGES_SQL} select n.subject, n.topic_key, coalesce(string_agg(distinct prerequisite_key, ',' order by prerequisite_key), '') prerequisites from nodes n left join fe using (subject, topic_key) group by all")
def _(spark, sf):
    needs = _edges(spark, sf).groupBy("subject", "topic_key").agg(F.array_join(F.array_sort(F.collect_set("prerequisite_key")), ",").alias("p"))
    return _nodes(spark, sf).select("subject", "topic_key").join(needs, ["subject", "topic_key"], "left").select("subject", "topic_key", F.coalesce("p", F.lit("")).alias("prerequisites"))


@query("M8_prerequisite_depth", f"with recursive {EDGES_SQL}, walk as (select distinct subject, prerequisite_key node, 0 depth from dag e where not exists (select 1 from dag p where p.subject = e.subject and p.topic_key = e.prerequisite_key) union all select e.subject, e.topic_key, depth + 1 from walk w join dag e on e.subject = w.subject and e.prerequisite_key = w.node) select subject, node, max(depth)::int depth from walk group by all")
def _(spark, sf):
    return G.depths(_edges(spark, sf).filter("prerequisite_key > topic_key"))


@query("O12_adjacency", f"with {EDGES_SQL} select n.subject, n.topic_key node, coalesce(string_agg(distinct e.topic_key, ',' order by e.topic_key), '') targets from nodes n left join fe e on e.subject = n.subject and e.prerequisite_key = n.topic_key group by all")
def _(spark, sf):
    return G.adjacency(_nodes(spark, sf), _edges(spark, sf)).select("subject", "node", F.array_join("targets", ",").alias("targets"))


@query("F8_edge_sample", f"with {EDGES_SQL} select subject, topic_key, prerequisite_key from fe order by all limit 8")
def _(spark, sf):
    c = ["subject", "topic_key", "prerequisite_key"]
    return _edges(spark, sf).select(*c).orderBy(*c).limit(8)


@query("D5_count_subquery", f"with {EDGES_SQL} select count(*) n from (select distinct subject, topic_key from fe)")
def _(spark, sf):
    return _edges(spark, sf).select("subject", "topic_key").distinct().agg(F.count("*").alias("n"))


@query("D14_graph_counters", f"with {EDGES_SQL} select count(*) candidates, (select count(*) from fe) validated, count(*) - (select count(*) from fe) invalid from pe")
def _(spark, sf):
    parsed = G.parsed_edges(_raw(spark, sf))
    kept = G.filtered_edges(parsed, _nodes(spark, sf), 0.55).select("subject", "topic_key", "prerequisite_key", F.lit(1).alias("ok"))
    rows = parsed.join(kept, ["subject", "topic_key", "prerequisite_key"], "left")
    return rows.agg(F.count("*").alias("candidates"), F.count("ok").alias("validated"), F.count_if(F.col("ok").isNull()).alias("invalid"))


@query("O1_presented_card", "with d as (select n_nationkey k, n_nationkey % 3 = 0 due from nation) select k, case when due and k % 2 = 0 then k + 100 else k end::bigint served from d")
def _(spark, sf):
    k = F.col("n_nationkey").cast("long")
    return S.table(spark, sf, "nation").select(k.alias("k"), F.when((k % 3 == 0) & (k % 2 == 0), k + 100).otherwise(k).alias("served"))


