import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import data


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case."""
    return spark.createDataFrame(data.odd_rows(), data.SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    """Documents without rows."""
    return spark.createDataFrame([], data.SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{data.SMALL}/documents.parquet")
