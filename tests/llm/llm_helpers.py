"""Shared by the tests of the training-data operators (the session comes from
tests/conftest.py)."""

import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture()
def docs(spark):
    """Frame of documents from (doc_id, text) pairs, the other columns filled."""
    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        return spark.createDataFrame(
            [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], schema)
    return make
