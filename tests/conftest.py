import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def catalog(spark):
    from shiftwright import default_catalog

    return default_catalog()


@pytest.fixture
def corpus(spark):
    """Build a files table from {path: text}, all of one project."""
    def build(texts, project="p"):
        rows = [(project, path, text) for path, text in texts.items()]
        return spark.createDataFrame(rows, "project string, path string, content string")

    return build
