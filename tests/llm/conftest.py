import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF_SMALL, SF_MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from assetpulse.session import build_session
    return build_session("local[4]", app="assetpulse-tests", shuffle_partitions=8,
                         extra={"spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang) rows, with more columns whose names clash."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), 1.5, "x", 7, 3) for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA + ", score double, h string, pos int, row long")
    return make


@pytest.fixture(scope="session")
def small_texts(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}
