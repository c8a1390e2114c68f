import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from staygrid.session import build_session

    s = build_session("tests", "local[8]", **{"spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "4"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def val(spark):
    """Value of one expression for one row."""
    from pyspark.sql import functions as F

    def run(build, **values):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
        return row.select(build(*[F.col(k) for k in values]).alias("v")).first().v

    return run
