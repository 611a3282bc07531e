import pytest
from llm_rows import SCHEMA, prose, rows_of


@pytest.fixture(scope="session")
def make(spark):
    def of(rows):
        return spark.createDataFrame(rows, SCHEMA)

    return of


@pytest.fixture(scope="session")
def edge_docs(make):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long_text = prose(1, 60_000)
    rows = rows_of([prose(2, 80), None, "", " \n ", "12 + 3", long_text, prose(3, 5), prose(2, 80), "é" * 5000, "x" * 200_000])
    rows += [(None,) * 12, (None, prose(4, 30), *(None,) * 10), rows[0], rows[0]]
    return make(rows).cache()
