"""Fixtures of the small document tables."""

import pytest
from llm_helpers import SCHEMA, documents


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows):
        data = [("x", i, t, lang, s, None if t is None else len(t), 1, "big", 2, 3, 4) for i, t, lang, s in rows]
        return spark.createDataFrame(data, SCHEMA)

    return make


@pytest.fixture(scope="session")
def docs(frame, rows):
    return frame(rows).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
