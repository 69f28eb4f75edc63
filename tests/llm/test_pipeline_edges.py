"""The pipeline as a whole on odd tables: nulls, repeated ids, one very long text, more columns, no rows at all."""

import random

import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, ids string, decoded int, _row string"


def good(rnd, n):
    return ". ".join(" ".join(rnd.choice("the router sends every packet to a neighbour that knows the way and waits for an answer".split()) for _ in range(9)).capitalize() for _ in range(n)) + "."


def run(spark, path, rows, labels):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return corpus_pipeline.run(spark, str(path)).collect()


def test_odd_tables(spark, tmp_path):
    rnd = random.Random(5)
    texts = [good(rnd, 6) for _ in range(60)] + ["$$$ ### " * 30 + str(k) for k in range(20)]
    rows = [(k, t, "en", f"s{k % 12}", len(t), "x", 1, "y") for k, t in enumerate(texts)]
    labels = [(k, int(k < 60), 0) for k in range(80)] + [(None, 1, 0), (3, None, None), (999, 1, 1)]
    odd = [(None, None, None, None, None, None, None, None), (None, texts[0], "en", None, 1, "x", 1, "y"), (5, texts[7], "en", "s1", 1, "x", 1, "y"), (5, "", "en", "s1", 0, "x", 1, "y"), (200, None, "en", "s2", None, "x", 1, "y"), (201, "a\n\n\na", "", "", 4, "x", 1, "y"), (202, (texts[1] + "\n") * 400, "en", "s3", 1, "x", 1, "y")]
    out = run(spark, tmp_path, rows + odd, labels)
    assert out and {"doc_id", "ids", "n_tokens", "text"} <= set(out[0].asDict())
    ids = {r.doc_id for r in out}
    assert len(ids & set(range(60))) >= 40  # of clean documents some are taken twice, few are not taken
    assert not ids & set(range(62, 80)) or len(ids & set(range(60, 80))) <= 2
    assert all(r.n_tokens == len(r.ids) and r.text for r in out)


def test_no_rows(spark, tmp_path):
    assert run(spark, tmp_path, [], []) == []


def test_no_labels(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(k, good(rnd, 5), "en", "s", 1, None, None, None) for k in range(10)]
    assert isinstance(run(spark, tmp_path, rows, []), list)
