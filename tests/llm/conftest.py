import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import CLASH, SCHEMA, documents


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The documents with further columns whose names clash."""
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns(
        {c: F.lit(f"mine {c}") for c in CLASH}
    )


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
