import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from passagework.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
           "spark.ui.showConsoleProgress": "false"},
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def value(spark):
    """Evaluate one column expression over one string."""

    def run(make, text):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(text,)], "t string")
        return df.select(make(F.col("t")).alias("v")).first()["v"]

    return run
