"""Questions are made and validated once, and written."""

from tessera import catalog


def test_questions_are_validated_once(spark):
    assert "part.parquet" not in " ".join(catalog.queries()["H12_kept_questions"](spark, "/root/testdata/sf0.001").inputFiles())
