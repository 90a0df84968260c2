from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with columns whose names the operators use themselves."""

    def build(rows=(), schema=SCHEMA + ", node long, ids binary, spans string, key int, bucket int, label string"):
        full = []
        for row in rows:
            own, text, lang = (*row, None)[:3]
            full.append((own, text, lang, "src", None if text is None else len(text), 7, b"x", "s", 1, 2, "l"))
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def corpus(documents):
    """(doc_id, text, lang) of all test documents, by id."""
    return sorted((r.doc_id, r.text, r.lang) for r in documents.select("doc_id", "text", "lang").collect())
