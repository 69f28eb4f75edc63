"""Tokenizer alignment against sets of byte offsets."""

import random
from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")

from tessera.llm import align  # noqa: E402

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox", "naïve café, déjà-vu: 日本語のテキスト 🙂🙂", "<|endoftext|> <s> </s> <unk>", "", None, "a", " ", "  two  spaces ", "line\nbreak\ttab\r\n", "x" * 3000, "aé" * 700,
    "The quick brown fox", "▁already", "zero\x00byte", "ﬁ ligature ½", "1234567890 " * 50, " nbsp", "the the the the", "Ünïcödé " * 30,
]


def plain(texts):
    with open(A, "rb") as f:
        a = align.Byte(f.read())
    with open(B, "rb") as f:
        b = align.Piece(f.read())
    rows, linked = [], []
    for t in texts:
        ia, ib = (a.ids([t])[0], b.ids([t])[0]) if t else ([], [])
        if t and any(b"".join(k.table[i] for i in ids) != (" " + t).encode() for k, ids in ((a, ia), (b, ib))):
            ia, ib = [], []
        cuts = []
        for k, ids in ((a, ia), (b, ib)):
            at, ends = 0, []
            for i in ids:
                at += len(k.table[i])
                ends.append(at)
            cuts.append(ends)
        groups, last = [], 0
        for end in sorted(set(cuts[0]) & set(cuts[1])):
            groups.append([[i for i, e in zip(ids, ends, strict=True) if last < e <= end] for ids, ends in ((ia, cuts[0]), (ib, cuts[1]))])
            last = end
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        rows.append([len(ia), len(ib), len(groups), sum(links.values()), ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)])
        linked.append(links)
    count = Counter(p for links in linked for p in links)
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    return [(*r[:4], sum(n for p, n in links.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in links.items()), r[4]) for r, links in zip(rows, linked, strict=True)]


def test_ranks_give_the_same_ids():
    """The rank library's ids are those of the file's own library, also where it gives up."""
    with open(A, "rb") as f:
        content = f.read()
    own, ranked = align.Byte(content), align.Byte(content, P.PATTERN)
    assert own.ranked is None and ranked.ranked is not None
    rnd = random.Random(1)
    letters = "aeiou  thrs\n\t'0189.,-éß東🙂\u00a0\u2003\u200bA_"
    texts = [t for t in TEXTS if t] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 300))) for _ in range(500)]
    texts += [" " * 200_000, "a" * 200_000, "\n" * 50_000 + "x", " " * 3000 + "y", "é" * 30_000, "!?" * 50_000, "don't I'LL we've 'S", "1" * 40_000]
    assert ranked.ids(texts) == own.ids(texts)
    turned = content.replace(b'"dropout":null', b'"dropout":0.1')
    assert turned == content or align.Byte(turned, P.PATTERN).ranked is None


@pytest.mark.parametrize("broadcast_pairs", [0, 20, 1 << 18])
def test_alignment(spark, tmp_path, broadcast_pairs):
    rnd = random.Random(9)
    words = "alpha beta, gamma-delta 42 étude Straße 東京 don't __init__ \n\n ... !?".split(" ")
    texts = TEXTS + [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(None if k == 3 else k // 2, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, links string, row int").repartition(5)
    path = f"file://{tmp_path}/aligned"
    align.align(docs, A, B, pattern=P.PATTERN if broadcast_pairs else None).write.parquet(path)
    got = align.scored(spark.read.parquet(path), align.piece_count(B), broadcast_pairs)
    found = sorted((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.alignment) for r in got.collect())
    assert found == sorted(plain(texts))
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r.doc_id) for r in docs.collect())


def test_many_links_in_blocks(monkeypatch):
    monkeypatch.setattr(align, "LINKS_AT_ONCE", 7)
    with open(A, "rb") as f, open(B, "rb") as g:
        both = align.Pair(align.Byte(f.read()), align.Piece(g.read()))
    a, b = both.sides(TEXTS)
    of_a, of_b = align.groups(a, b)
    text, pair, times = align.linked(a, b, of_a, of_b, len(both.b.table))
    assert times.sum() == sum(r[3] for r in plain(TEXTS)) and len(set(zip(text.tolist(), pair.tolist(), strict=True))) == len(text)


def test_no_rows(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    align.align(spark.createDataFrame([], "doc_id long, text string"), A, B).write.parquet(path)
    assert align.scored(spark.read.parquet(path), align.piece_count(B)).count() == 0
