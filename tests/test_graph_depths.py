"""Longest chains: long ones, wide ones, cycles."""

from tessera.operators import graph

SCHEMA = "subject string, topic_key string, prerequisite_key string"


def depths(spark, rows):
    return {(r.subject, r.node): r.depth for r in graph.depths(spark.createDataFrame([(s, b, a) for s, a, b in rows], SCHEMA)).collect()}


def test_chain(spark):
    got = depths(spark, [("s", f"{k:05d}", f"{k + 1:05d}") for k in range(5000)])
    assert got == {("s", f"{k:05d}"): k for k in range(5001)}


def test_layers(spark):
    """20^50 paths; a node keeps one number."""
    rows = [("s", f"{k}.{a}", f"{k + 1}.{b}") for k in range(49) for a in range(20) for b in range(20)]
    assert depths(spark, rows) == {("s", f"{k}.{a}"): k for k in range(50) for a in range(20)}


def test_mixed_and_cycles(spark):
    rows = [("a", "x", "y"), ("a", "y", "z"), ("a", "x", "z"), ("a", "z", "t"), ("a", "z", "t"), ("b", "x", "y")]
    rows += [("c", "1", "2"), ("c", "2", "3"), ("c", "3", "1"), ("c", "3", "4"), ("c", "0", "1"), ("c", "0", "9"), ("d", "p", "q"), ("d", "q", "p"), ("d", "q", "r")]
    want = {("a", "x"): 0, ("a", "y"): 1, ("a", "z"): 2, ("a", "t"): 3, ("b", "x"): 0, ("b", "y"): 1, ("c", "0"): 0, ("c", "9"): 1}
    want |= dict.fromkeys([("c", k) for k in "1234"] + [("d", k) for k in "pqr"])
    assert depths(spark, rows) == want
    assert depths(spark, []) == {}
