import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a table of documents from (doc_id, text[, lang[, source]])."""

    def make(rows, extra=None):
        full = [(r[0], r[1], *(r[2:] + (None,) * (4 - len(r))), len(r[1]) if r[1] is not None else None) for r in rows]
        schema = DOCS
        if extra:
            full = [(*r, *extra.values()) for r in full]
            schema += "".join(f", {k} string" for k in extra)
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def tables(spark, sf):
    return lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
