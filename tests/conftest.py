from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def make_spark(cpus: str = "*"):
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lakelens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", f"file://{scratch}/checkpoints")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.driver.extraJavaOptions", f"-Dderby.system.home={scratch}/derby")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    s = make_spark()
    yield s
    s.stop()


@pytest.fixture(scope="session")
def scratch():
    """A fresh directory per test run for generated inputs."""
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture(scope="session")
def users(spark):
    """The reference's three-row users table: one NULL age."""
    return spark.createDataFrame(
        [(1, "Alice", 30), (2, "Bob", 25), (3, "Charlie", None)],
        "id int, name string, age int")


def by_col(df):
    return {r["column_name"]: r for r in df.collect()}
