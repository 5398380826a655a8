import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Builds documents: rows of (doc_id, text) or (doc_id, text, source), with columns whose names operators use inside."""

    def build(*rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, "x", 1, 2.5, None) for r in rows]
        return spark.createDataFrame(full, f"{DOCS}, digest string, `row` bigint, size double, body string")

    return build


@pytest.fixture
def rows():
    return lambda df, *columns: sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
