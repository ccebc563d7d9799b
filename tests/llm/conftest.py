from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, component long, bucket int"


@pytest.fixture
def docs(spark):
    """A documents table, with columns whose names the operators use themselves."""

    def make(*rows):
        full = [(i, text, *rest, *[None] * (3 - len(rest)), "k", 1, 2, 3) for i, text, *rest in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def documents(spark):
    from ..conftest import SF

    return spark.read.parquet(f"{SF}/documents.parquet")
