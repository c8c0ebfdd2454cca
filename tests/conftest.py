import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def memories(spark):
    """Makes a memory table of given rows; columns that a row does not give are null."""
    from tidepool.schema import MEMORIES

    names = [x.split()[0] for x in MEMORIES.split(", ")]

    def make(*rows: dict):
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], MEMORIES)

    return make
