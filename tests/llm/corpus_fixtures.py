"""Fixtures of the corpus operators' tests (a module of its own name: ``conftest`` is the library's)."""

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows (doc_id, text) with columns whose names clash with those that operators add."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "s", None, "x") for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, kept string")
    return make
