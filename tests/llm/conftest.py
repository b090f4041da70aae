import pytest
from llm.corpus import SCHEMA, records

from tidemill.llm.text import session


@pytest.fixture(scope="session")
def rows():
    return records()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return session(spark).createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return session(spark).createDataFrame([], SCHEMA)
