import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def partitions(spark):
    """Runs a function under several numbers of shuffle partitions and wants equal results."""

    def check(f, numbers=(1, 4, 50)):
        before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
        for n in numbers:
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(f())
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert all(x == found[0] for x in found)
        return found[0]

    return check
