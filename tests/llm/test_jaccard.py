"""The pipeline's near-dedup against brute force: every pair of five-word Jaccard 0.8 or more is linked, and no other."""

import os
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
pytest.importorskip("tessera.llm")
import corpus_pipeline  # noqa: E402

from tessera.llm import jaccard, simhash  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    found = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else frozenset()


def brute(texts, similarity=0.8):
    """The number of each text's component."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) * 10 >= round(10 * similarity) * len(a | b) > 0:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def edited(rnd, text, n):
    out = text.split()
    for i in rnd.sample(range(len(out)), n):
        out[i] = f"new{rnd.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    said = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    out, passage, base = [None, "", " \n", "one", "One", "a b c", "a b c d e", "A b C d e"], said(60), said(200)
    for _ in range(40):  # around the limit: each edit takes up to five of some 200 runs
        own = said(rnd.randint(40, 250))
        out += [own, *(edited(rnd, own, n) for n in (1, 2, 3, 4, 5)), own.upper()]
    out += [edited(rnd, base, rnd.randint(0, 3)) for _ in range(60)]  # one large group of near copies
    out += [passage + " " + said(rnd.randint(1, 40)) for _ in range(60)]  # one passage in many texts, alike or not
    for _ in range(12):  # a chain of small steps
        out.append(edited(rnd, out[-1], 1))
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("max_bits", [0, 8])
def test_components(spark, texts, max_bits):
    group = brute(texts)
    least = {}
    for i, g in enumerate(group):
        least[g] = min(least.get(g, i), i)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.similar(docs, max_bits=max_bits).collect()}
    assert got == {i: least[g] for i, g in enumerate(group)}


def test_stage_removes_loose_copies(spark, texts):
    group = brute(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({g: i for i, g in reversed(list(enumerate(group)))}.values())


def test_ids(spark):
    """Null ids stay and link others; a repeated id stays if one of its rows is its component's; an empty table stays empty."""
    t = " ".join(f"w{i}" for i in range(100))
    rows = [(None, t + " x"), (None, None), (3, t + " x y"), (1, t), (1, "quite another text"), (5, "alone"), (5, t)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.similar(docs).collect())
    assert got == sorted([("None", "1"), ("None", "None"), ("3", "1"), ("1", "1"), ("1", "1"), ("5", "5"), ("5", "1")])
    assert sorted(str(r.doc_id) for r in simhash.drop_similar(docs).collect()) == ["1", "1", "5", "5", "None", "None"]
    assert simhash.drop_similar(docs.filter(F.lit(False))).count() == 0


def test_sketches():
    """Sketches never differ in more bits than the sets in hashes, whichever size is folded."""
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, max(1, n - int(rng.integers(0, 1 + n // 5))), replace=False), rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 5))).astype(np.uint64)]))
        x, y = sorted((jaccard.sketch(a), jaccard.sketch(b)), key=len)
        if len(y) > len(x):
            assert len(y) == 2 * len(x)
            y = y[: len(x)] ^ y[len(x) :]
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(np.setxor1d(a, b))
