import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gristmill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", app="tests", shuffle_partitions=8, spark__driver__memory="8g",
                            spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """rows(schema, *tuples) -> DataFrame."""
    return lambda schema, *values: spark.createDataFrame(list(values), schema)


@pytest.fixture
def column(spark):
    """column(function, *texts) -> the function's value per text, in order."""
    from pyspark.sql import functions as F

    def apply(function, *texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
        return [r.v for r in df.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()]

    return apply
