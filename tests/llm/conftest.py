import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) or (doc_id, text, source, lang) rows, with extra columns of clashing names."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            df = df.selectExpr("*", "1 AS k", "2 AS n", "3 AS size", "4 AS node", "5 AS shard", "6 AS score", "7 AS t", "8 AS line")
        return df

    return make
