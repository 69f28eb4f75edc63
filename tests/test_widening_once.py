"""One search serves the answers and all rounds of widening."""

from tessera import catalog


def test_widening_searches_once(spark):
    files = " ".join(catalog.queries()["I11_iterative_widening"](spark, "/root/testdata/sf0.001").inputFiles())
    assert "documents.parquet" not in files and "benchmark.parquet" not in files
