import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sparquill.session import build_session

    return build_session("tests", 8, shuffle_partitions=4, memory="8g")


@pytest.fixture
def values(spark):
    """Evaluate a column function on literal strings: values(fn, "a", "b") -> [fn(a), fn(b)]."""
    from pyspark.sql import functions as F

    def run(fn, *inputs, type="string"):
        rows = [(i, v) for i, v in enumerate(inputs)]
        df = spark.createDataFrame(rows, f"i int, x {type}")
        return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]

    return run
