import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))),
                os.path.dirname(os.path.abspath(__file__))]

from llm_tables import DOCS, EXTRA, edge_rows  # noqa: E402


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(*r, *([None] * 10)) for r in edge_rows()]
    return spark.createDataFrame(rows, f"{DOCS}, {EXTRA}").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], f"{DOCS}, {EXTRA}")
