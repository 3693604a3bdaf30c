import os

import pyarrow.parquet as pq
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    if not os.path.exists(f"{SF}/documents.parquet"):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def texts(sf):
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, very long and repeated texts, repeated and null ids, clashing extra columns."""
    long = "the quick brown fox jumps over a lazy dog " * 3000
    rows = [(1, "alpha beta gamma", "en"), (1, "alpha beta gamma", "en"), (1, "another text under the same id", None), (None, "no id here", "en"), (None, None, None), (2, None, "en"), (3, "", "en"), (4, "   ", "en"), (5, long, "en"), (6, long + "x", "en"), (7, "12345 !!!", "de"), (8, "e\u0301\U0001f600 \u3000\x00 tab\tnew\nline", "fr")]
    return spark.createDataFrame([(*r, "kept", 9, 0.5, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, did string")


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)
