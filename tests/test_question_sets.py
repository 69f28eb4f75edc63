"""Question sets against brute force: whole texts, long chains of similar questions, copies of questions that go."""

import random

import pytest

from tessera.operators import questions


def greedy(rows, threshold=0.8):
    kept = []
    for i, text in sorted(rows):
        t = text.strip().lower()
        w = set(t.split())
        if not any(t == u or (w and v and len(w & v) / len(w | v) > threshold) for _, u, v in kept):
            kept.append((i, t, w))
    return [i for i, *_ in kept]


def chain(n):
    """Each question shares all but one of its words with the next."""
    return [(i, " ".join(f"w{k}" for k in range(i, i + 12))) for i in range(n)]


@pytest.mark.parametrize(("n", "local"), [(400, 200_000), (40, 5)])
def test_long_chain(spark, n, local):
    """More links than the 64 rounds of before settled; with a small `local` the rounds are gone through."""
    rows = chain(n)
    q = spark.createDataFrame(rows, "id long, query string")
    assert sorted(r.id for r in questions.greedy_dedup(q, local=local).collect()) == greedy(rows) == list(range(0, n, 2))


@pytest.mark.parametrize("local", [200_000, 0])
def test_copies_and_variants(spark, local):
    """A copy of a question that goes because of a third one goes as well."""
    rnd = random.Random(3)
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j k"), (3, "A b c d e f g h i j k "), (4, ""), (5, " ")]
    words = [f"v{k}" for k in range(40)]
    for i in range(10, 70):
        rows.append((i, " ".join(rnd.sample(words, 10)) if i % 3 == 0 else rows[-1][1] + f" x{i % 2}"))
    q = spark.createDataFrame(rows, "id long, query string")
    assert sorted(r.id for r in questions.greedy_dedup(q, local=local).collect()) == greedy(rows)


def tables(spark, path, n):
    """Benchmark texts that differ only after a long common beginning."""
    rnd = random.Random(4)
    words = [f"v{k}" for k in range(60)]
    rows = [(i, "all begin with the same six words " + " ".join(rnd.sample(words, rnd.randint(15, 30)))) for i in range(n)] + [(n, None)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_whole_texts(spark, tmp_path):
    from tessera import catalog
    from tessera.plans.questions import _whole_questions

    tables(spark, tmp_path, 40)
    rows = [(r.id, r.query) for r in _whole_questions(spark, str(tmp_path)).collect()]
    assert len(rows) == 41 + 31 and len({i for i, _ in rows}) == len(rows)
    kept = sorted(r.id for r in catalog.queries()["H11_whole_texts"](spark, str(tmp_path)).collect())
    assert kept == greedy(rows) and set(range(40)) <= set(kept)
    sets = {i: set(t.lower().split()) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.8}
    got = {(r.a, r.b) for r in catalog.queries()["O14_whole_texts"](spark, str(tmp_path)).collect()}
    assert {p for p in got if sets[p[0]]} == want and len(want) >= 30


def test_kept_questions(spark):
    from tessera import catalog
    from tessera.operators import questions as O
    from tessera.plans.questions import _questions

    sf = "/root/testdata/sf0.001"
    valid = [(r.id, r.query) for r in O.validated(_questions(spark, sf)).filter("size(errors) = 0").collect()]
    got = {r.id: r.linked for r in catalog.queries()["H12_kept_questions"](spark, sf).collect()}
    assert sorted(got) == greedy(valid) and valid
    assert all(len(x.split(",")) <= 3 and (i % 4 == 0 or str(2 * i) in x.split(",")) for i, x in got.items())
