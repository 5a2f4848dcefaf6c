from __future__ import annotations

import pytest
from samples import ODD, SAMPLE


@pytest.fixture(scope="session")
def sample(spark):
    """(doc_id, text) of the smallest sample, in order."""
    rows = spark.read.parquet(f"{SAMPLE}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r[0], r[1]) for r in rows)


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of documents from (doc_id, text) or (doc_id, text, source), over three partitions."""
    def build(rows):
        rows = [(*r, "s") if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return build


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, repeated rows, missing ids, long texts, signs of all kinds."""
    return list(ODD)
