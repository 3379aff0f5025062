import os
import sys
from pathlib import Path

import pytest

REPO = str(Path(__file__).parent.parent)
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = REPO + os.pathsep + os.environ.get("PYTHONPATH", "")


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.default.parallelism", "2")
        .getOrCreate()
    )


def pytest_sessionstart():
    """Column expressions in test modules need a session when they are collected."""
    session().sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return session()
