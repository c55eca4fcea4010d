import os

import duckdb
import pytest

from tidemark.llm.common import shipped

DATA = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def importable(spark):
    shipped(spark)


def read(name, folder=SMALL):
    path = f"{folder}/{name}.parquet"
    pattern = f"{path}/*.parquet" if os.path.isdir(path) else path
    return duckdb.sql(f"SELECT * FROM read_parquet('{pattern}')").fetchdf()


def odd_docs(spark, *texts, ids=None):
    """Documents of the given texts with clashing extra columns."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", 0, "x", True, "y") for i, t in zip(ids, texts)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, key string, kept boolean, sha string"
    )
