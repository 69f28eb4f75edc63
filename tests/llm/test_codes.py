"""Vector codes against a plain k-means over all entries."""

import random

import numpy as np
from pyspark.sql import types as T

from tessera.llm import codes

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.StringType()), T.StructField("code", T.StringType())])


def plain(rows, entries, rounds=4, parts=4, scale=1024):
    """(code, error) by row and the books, with whole Python integers."""
    kept = [(i, v) for i, v, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    longest = max((len(v) for _, v in kept), default=0)
    width = -(-longest // parts)
    ints = [(i, [int(np.floor(x * scale)) for x in v] + [0] * (width * parts - len(v))) for i, v in kept]
    seeds = [v for _, v in sorted(zip(kept, ints, strict=True), key=lambda r: (r[0][0] is None, r[0][0] or 0, r[0][1]))[:entries]]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in ints]
    books = [[v[p * width : (p + 1) * width] for _, v in seeds] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for x in cut:
                own.setdefault(nearest(x[p], books[p])[1], []).append(x[p])
            for j, xs in own.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [[nearest(x[p], books[p]) for p in range(parts)] for x in cut]
    return sorted((str(i), [j for _, j in f], sum(d for d, _ in f)) for (i, _), f in zip(kept, found, strict=True)), books


def check(spark, rows, entries):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    books = codes.fit(df, entries=entries)
    got = sorted((str(r.vec_id), list(r.code), r.error) for r in codes.encode(df, books, keep=["vec_id", "label", "code"]).collect())
    want, own = plain(rows, entries)
    assert got == want
    assert [b.tolist() for b in books.entries] == own
    return books


def test_codes(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(16)], None if i % 5 == 0 else str(i % 3)) for i in range(300)]
    rows += [(1000, None, "a"), (1001, [None, *[0.1] * 15], "a"), (1002, [float("nan")] * 16, "a"), (1003, [float("inf")] * 16, "a"), (1004, [-float("inf")] * 16, "a")]
    rows += [(7, rows[3][1], "b"), (7, rows[3][1], "b"), (None, rows[5][1], None), (1005, [0.5] * 3, "s"), (1006, [], "e"), (1007, [1e3] * 16, "l"), (-4, [-1e3] * 14, "l")]
    rows += [(2000 + i, [round(rnd.random()) / 4 for _ in range(16)], "t") for i in range(60)]  # many ties
    books = check(spark, rows, 40)
    assert len(books.entries[0]) == 40


def test_large_components_and_few_rows(spark):
    check(spark, [(i, [2.0**k * (i - 1) for k in (0, 20, 30, 10)] + [1.0] * 4, "x") for i in range(4)], 256)
    check(spark, [(1, [1.0, 2.0, 3.0, 4.0, 5.0], "x")], 256)
    empty = spark.createDataFrame([], SCHEMA)
    none = codes.fit(empty)
    assert codes.encode(empty, none).count() == 0 and none.sha256() == codes.hashlib.sha256(b"").hexdigest()


def test_bounds_filter_and_keep_the_nearest():
    rnd = np.random.default_rng(1)
    entries = rnd.integers(-1000, 1000, (200, 12))
    rows = entries[rnd.integers(0, 200, 500)] + rnd.integers(-60, 60, (500, 12))
    book = codes.Book(entries)
    near, far, taken = book.nearest(rows)
    all_ = ((rows[:, None, :] - entries[None]) ** 2).sum(2)
    assert (near == all_.argmin(1)).all() and (far == all_.min(1)).all()
    assert taken < 0.1 * rows.shape[0] * entries.shape[0]
    wide = codes.Book(entries.astype(np.int64) << 50)
    near2, far2, _ = wide.nearest(rows.astype(np.int64) << 50)
    assert (near2 == near).all() and [int(x) for x in far2] == [int(x) << 100 for x in far]
