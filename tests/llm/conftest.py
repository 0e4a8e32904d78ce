import pytest

from trialloom.llm.common import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, node long, size long"


@pytest.fixture(scope="session")
def shipped(spark):
    ship(spark)
    return spark


@pytest.fixture
def documents(shipped):
    """Rows (doc_id, text) or (doc_id, text, lang, source) as documents with columns whose names operators use inside."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None, 0.25, 7, 8, 9) for r in rows]
        return shipped.createDataFrame(full, DOCS)

    return build
