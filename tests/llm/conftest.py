import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DATA = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def data():
    if not os.path.exists(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text[, lang, source]) rows, with extra columns whose names clash."""
    from pyspark.sql import functions as F

    def make(rows, lang="en"):
        full = [(r[0], r[1], r[2] if len(r) > 2 else lang, r[3] if len(r) > 3 else "s", None) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        for name in ("k", "t", "row", "n", "h", "node", "digest", "lines", "size", "copies", "kept", "score", "id",
                     "best", "batch", "label", "place", "y"):
            df = df.withColumn(name, F.lit("extra"))
        return df
    return make
