"""Golden cases of the domain: states, mastery, graphs, retrieval, questions, text, streams."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import query as Q
from tessera.functions import text as X
from tessera.operators import corpus, graph, questions, retrieval, reviews
from tessera.sources import files
from tessera.streaming.reviews import review

DAY = dt.datetime(2025, 1, 10)


def attempts(spark, *histories):
    rows = [(100 * c + k, 1, c, DAY + dt.timedelta(hours=k), q) for c, h in enumerate(histories) for k, q in enumerate(h)]
    return spark.createDataFrame(rows, "id long, user_id long, card_id long, attempted_at timestamp, quality int")


def test_review_states(spark):
    got = {r.card_id: (r.repetitions, r.interval_days, round(r.ease_factor, 6), r.lapses) for r in reviews.review_states(attempts(spark, [5], [5, 5], [5, 5, 1], [5, 4, 3, 5], [3] * 6, [5, 5, 5, 5, 0], [0, 0, 5])).collect()}
    assert got == {0: (1, 1, 2.6, 0), 1: (2, 6, 2.7, 0), 2: (0, 3, 2.7, 1), 3: (4, 38, 2.56, 0), 4: (6, 68, 1.66, 0), 5: (0, 7, 2.9, 1), 6: (1, 1, 2.6, 2)}
    with pytest.raises(Exception, match="quality must be"):
        reviews.review_states(attempts(spark, [6])).collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40))
def test_stream_twin_is_sane(history):
    state = (0, 0, 2.5, 0)
    for q in history:
        state = review(state, q)
    assert state[2] >= 1.3 and state[3] == sum(q < 3 for q in history) and (not history or state[1] >= 1)


def test_stream_and_batch_agree(spark):
    histories = [[5, 4, 3, 5], [3] * 6, [5, 5, 5, 5, 0], [2, 5, 5, 4, 3, 3, 3, 5, 1, 5]]
    for r in reviews.review_states(attempts(spark, *histories)).collect():
        state = (0, 0, 2.5, 0)
        for q in histories[r.card_id]:
            state = review(state, q)
        assert (r.repetitions, r.interval_days, r.lapses) == (state[0], state[1], state[3]) and abs(r.ease_factor - state[2]) < 1e-9


def test_mastery_and_swot(spark):
    a = attempts(spark, [1, 2, 1], [5, 5, 4], [5, 5, 5, 2, 1, 1])
    names = spark.createDataFrame([(0, "os", "a"), (1, "os", "b"), (2, "os", "c"), (3, "os", "d")], "card_id long, subject string, topic_key string")
    past, later = DAY - dt.timedelta(days=1), DAY + dt.timedelta(days=9)
    s = spark.createDataFrame([(1, 0, 2, past), (1, 1, 0, later), (1, 2, 1, past)], "user_id long, card_id long, lapses int, due_at timestamp")
    got = {r.topic_key: r for r in reviews.swot(reviews.mastery(a, s, names, F.lit(DAY))).collect()}
    assert round(got["a"].mastery, 3) == 26.667 and got["a"].bucket == "weakness" and round(got["a"].weakness, 3) == 71.0
    assert got["b"].mastery == 86.0 and got["b"].bucket == "strength" and round(got["b"].weakness, 3) == 9.1
    assert got["d"].mastery == 30.0 and got["d"].bucket == "opportunity" and got["d"].opportunity == 76.0
    p = spark.createDataFrame([(26.667, "weakness"), (86.0, "strength"), (30.0, "opportunity")], "m double, b string").select(F.round(reviews.priority(F.col("m"), F.col("b")), 3)).collect()
    assert [r[0] for r in p] == [101.333, 18.0, 84.0]


def test_next_cards(spark):
    cards = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    now, d = F.lit(DAY), dt.timedelta(days=1)
    states = spark.createDataFrame([(1, 1, DAY + d), (1, 2, DAY - d), (1, 5, DAY - 2 * d), (2, 7, DAY)], "user_id long, card_id long, due_at timestamp")
    got = reviews.next_cards(users, cards, states, now, 4).orderBy("user_id", "position").collect()
    assert [r.card_id for r in got if r.user_id == 1] == [5, 2, 3, 4] and [r.card_id for r in got if r.user_id == 2] == [7, 1, 2, 3]
    assert [r.card_id for r in reviews.next_cards(users, cards, states, now, 0).filter("user_id = 1").orderBy("position").collect()] == [5, 2, 3, 4, 6, 7]


def test_graph(spark):
    e = spark.createDataFrame([("os", "sync", "threads", 0.88, 1), ("os", "threads", "process", 0.95, 2), ("os", "process", "sync", 0.35, 3), ("cn", "b", "a", 0.9, 4), ("cn", "a", "b", 0.8, 5)], "subject string, topic_key string, prerequisite_key string, confidence double, ordinal int")
    gone = {(r.topic_key, r.prerequisite_key) for r in graph.break_cycles(e).filter("dropped").collect()}
    assert gone == {("process", "sync"), ("a", "b")}
    nodes = spark.createDataFrame([("g", "deadlock", 95.0), ("g", "process", 20.0), ("g", "x", 30.0), ("h", "a", 1.0), ("h", "b", 2.0)], "graph string, topic_key string, priority double")
    edges = spark.createDataFrame([("g", "deadlock", "process"), ("g", "deadlock", "process"), ("g", "x", "nowhere"), ("h", "a", "b"), ("h", "b", "a")], "graph string, topic_key string, prerequisite_key string")
    got = graph.priority_order(nodes, edges).orderBy("graph", "position").collect()
    assert [r.topic_key for r in got] == ["x", "process", "deadlock", "b", "a"] and [r.in_cycle for r in got] == [False] * 3 + [True] * 2


def test_bm25_and_fusion(spark):
    texts = [("t1", "deadlock occurs when processes wait forever"), ("t2", "process scheduling decides which process runs"), ("t3", "tcp handshake opens a connection")]
    chunks = spark.createDataFrame(texts, "id string, text string")
    asked = spark.createDataFrame([(1, "deadlock"), (2, "tcp handshake"), (3, "nothing known")], "query_id int, query string")
    got = retrieval.bm25(chunks, asked, 2).collect()
    assert {(r.query_id, r.rank, r.id) for r in got} == {(1, 1, "t1"), (2, 1, "t3")} and all(r.score > 0 for r in got)
    lists = [spark.createDataFrame([(1, c, k + 1) for k, c in enumerate(x)], "query_id int, id string, rank int") for x in ("abc", "bda")]
    merged = retrieval.rrf(lists).orderBy("rank").collect()
    assert [(r.id, round(r.score, 9)) for r in merged] == [("b", 0.032522475), ("a", 0.032266458), ("d", 0.016129032), ("c", 0.015873016)]


def test_context_and_evaluation(spark):
    rows = [(1, k, f"c{k}", "H", "word " * 100) for k in range(1, 6)]
    results = spark.createDataFrame(rows, "query_id int, rank int, id string, header_path string, text string")
    small, large = (retrieval.context(results, n).first() for n in (300, 2000))
    assert small.n < large.n == 5 and len(small.context) < len(large.context)
    assert [int(s[1]) for s in large.context.split("\n\n")] == [1, 2, 3, 5, 4]
    a = spark.createDataFrame([(1, "see [1] and [2] [99]"), (2, "none")], "query_id int, answer string")
    assert [(r["index"], r.id) for r in retrieval.citations(a, results).orderBy("index").collect()] == [(1, "c1"), (2, "c2")]
    e = spark.createDataFrame([(1, "short", ""), (2, "The scheduler picks [1] something quite unrelated here", "[1] H: paging tables"), (3, "The memory uses [1] paging tables for frames", "[1] H: paging tables frames")], "query_id int, answer string, context string")
    got = {r.query_id: r for r in retrieval.evaluated(e).collect()}
    assert got[1].missing == ["answer_too_short", "no_citations", "empty_context"] and got[1].confidence == 0.55
    assert got[2].missing == ["ungrounded_citation"] and got[3].is_complete


def test_query_understanding(spark):
    q = spark.createDataFrame([("What is deadlock and how to prevent it?",), ("hello!",), ("",), ("compare paging vs segmentation",), ("explain how to do x; then y",)], "q string")
    got = [tuple(r) for r in q.select(Q.needs_retrieval(F.col("q")), Q.complexity(F.col("q")), F.size(Q.sub_queries(F.col("q"))), Q.intent(F.col("q"))).collect()]
    assert got[0] == (True, "multi-part", 2, "definition") and got[1][:2] == (False, "simple") and got[2][0] is False and got[3][3] == "comparison"
    assert got[4] == (True, "multi-part", 2, "definition")


def test_questions(spark):
    rows = [(1, "what is a deadlock in an os"), (2, "what is a deadlock in an os"), (3, "what is deadlock"), (4, "what is a deadlock"), (5, ""), (6, "a b c d e f g h i"), (7, "a b c d e f g h i j"), (8, "b c d e f g h i j")]
    q = spark.createDataFrame(rows, "id long, query string")
    assert sorted(r.id for r in questions.greedy_dedup(q).collect()) == [1, 3, 4, 5, 6, 8]  # 7 goes, so 8 stays
    full = spark.createDataFrame([("Why does deadlock need circular wait?", "Because each process holds what the next one waits for, so none can go on until another lets go of it.", "factual", "hard", ["holds", "waits"])], "query string, answer string, question_type string, difficulty string, atomic_facts array<string>")
    full = full.withColumns({"llm_interview_score": F.lit("84"), "quality_score": F.lit(None).cast("string"), "llm_review_decision": F.lit("keep")})
    assert questions.validated(full).first().errors == []
    assert questions.validated(full.withColumn("llm_interview_score", F.lit("x"))).first().errors == ["Missing LLM score fields"]


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(corpus.dedup_sentences(F.lit("S1. S1. S2."))) == "S1. S2." and one(corpus.dedup_sentences(F.lit("Alpha. Alpha. tail without stop"))) == "Alpha."
    assert one(corpus.dedup_sentences(F.lit("## 1.2 Intro"))) == "## 1." and one(corpus.dedup_sentences(F.lit("no stop"))) == "no stop"
    assert one(corpus.collapse_repeats(F.lit(" a a a  b b a "))) == "a a b b a"
    assert one(X.slug(F.lit("  B+ Tree -- Index!  "))) == "b-tree-index" and one(X.slug(F.lit("..."))) == "core"
    assert one(X.jaccard(X.word_set(F.lit("what is deadlock")), X.word_set(F.lit("what is a deadlock")))) == 0.75
    book = spark.createDataFrame([("b", "skip\n## One\nbody\n#### Deep\ntext\n### Three\n\n## References\nlist\n# not a heading")], "book_id string, text string")
    got = [(r.n, r.header_path, r.chunk_type, r.text) for r in corpus.sections(book).orderBy("n").collect()]
    assert got == [(0, "One", "section", "body"), (1, "One >  > Deep", "section", "text"), (2, "References", "references", "list\n# not a heading")]


def test_files(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('# c\n// c\n\n{"query": "a", "quality_score": 3}\n{bad\n{"query": "b"}\n')
    assert [(r.query, r.quality_score) for r in files.read_records(spark, f"{tmp_path}/q.jsonl").orderBy("query").collect()] == [("a", 3), ("b", None)]
    with pytest.raises(Exception):  # noqa: B017
        files.read_records(spark, f"{tmp_path}/q.jsonl", strict=True).collect()
    (tmp_path / "books").mkdir()
    (tmp_path / "books/one.mmd").write_text("## A\nx")
    (tmp_path / "books/two.txt").write_text("no")
    assert [(r.book_id, r.text) for r in files.read_books(spark, f"{tmp_path}/books").collect()] == [("one", "## A\nx")]
    assert files.jdbc_url("postgresql://h/db") == "jdbc:postgresql://h/db"
