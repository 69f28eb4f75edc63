"""Documents are read once for the candidates of a hybrid search, whatever is made of these."""

import pytest

from tessera import catalog


@pytest.mark.parametrize("name", ["I5_hybrid_search", "I6_boosts"])
def test_candidates_are_written(spark, name):
    assert "documents.parquet" not in " ".join(catalog.queries()[name](spark, "/root/testdata/sf0.001").inputFiles())
