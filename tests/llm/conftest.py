import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, ids string, blob string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents with columns of clashing names from rows of (doc_id, text[, lang[, source]])."""

    def make(rows):
        full = []
        for doc_id, text, *rest in rows:
            lang, source = [*rest, *("en", "src0")[len(rest) :]]
            full.append((doc_id, text, lang, source, len(text or ""), "s", "i", "b"))
        return spark.createDataFrame(full, DOCS)

    return make
