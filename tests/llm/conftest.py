import pytest


@pytest.fixture
def rows(spark):
    """rows(schema, [...]) -> DataFrame over two partitions."""
    def make(schema, data):
        return spark.createDataFrame(data, schema).repartition(2) if data else spark.createDataFrame([], schema)
    return make
