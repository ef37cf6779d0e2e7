import pytest
from pyspark.sql import types as T

BODIES = T.StructType([T.StructField("src", T.StringType()), T.StructField("row_id", T.LongType()), T.StructField("body", T.StringType())])


@pytest.fixture(scope="session")
def bodies(spark):
    return lambda data: spark.createDataFrame(data, BODIES)
