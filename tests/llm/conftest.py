from __future__ import annotations

import pathlib

import pytest

DATA = pathlib.Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    if not DATA.exists():
        pytest.skip("no test data")
    return str(DATA)


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    """doc_id -> text of the given documents."""
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names the operators use inside."""
    def frame(rows, **more):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row string, words string, spans string, hits string"
        full = [(i, t, "en", more.get("source", {}).get(i, "s"), len(t or ""), "k", "r", "w", "p", "h") for i, t in rows]
        return spark.createDataFrame(full, schema)

    return frame
