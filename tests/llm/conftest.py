import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) pairs, with columns whose names the operators use inside."""

    def build(rows, extra=True):
        df = spark.createDataFrame([(k, t, "en", "src", len(t or "")) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        if extra:
            from pyspark.sql import functions as F

            for c in ("digest", "label", "score", "keep", "weight", "probability", "__topic", "__cuts", "id", "r", "kind", "record_id", "block", "bucket"):
                df = df.withColumn(c, F.lit(f"own {c}"))
        return df

    return build
