from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("lexiweight-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    """Folder of the driver tables; the test is skipped where there are none."""
    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    if not Path(path).is_dir():
        pytest.skip(f"no test tables in {path}")
    return path


@pytest.fixture()
def corpus(spark):
    """Make a corpus from (corpus, document, text) tuples."""

    def make(rows):
        return spark.createDataFrame(rows, "corpus string, document string, text string")

    return make
