import pytest


@pytest.fixture
def frame(spark):
    """Rows of documents, with columns that clash with names the operators use."""

    def build(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([tuple(r) + (None,) * (schema.count(",") + 1 - len(r)) for r in rows], schema)
        return df.withColumns({c: F.lit("x") for c in ("ref", "node", "size", "score", "kept", "piece", "label", "token")}).repartition(3)

    return build
