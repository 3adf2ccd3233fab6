import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_check import session

from gaugeframe.runtime import ROWS_PER_BUCKET, tune


@pytest.fixture(scope="session")
def spark():
    spark = tune(session(partitions=4))
    yield spark
    spark.stop()


@pytest.fixture(params=["whole groups", "buckets"])
def bucketing(request, spark):
    """Run a test once with whole groups and once with groups cut into buckets."""
    if request.param == "buckets":
        spark.conf.set(ROWS_PER_BUCKET, "7")
    yield request.param
    spark.conf.unset(ROWS_PER_BUCKET)
