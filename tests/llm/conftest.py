import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame over several partitions from rows and a schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3) if rows else spark.createDataFrame([], schema)
