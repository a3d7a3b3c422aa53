"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session", autouse=True)
def _tests_travel_with_tasks() -> None:
    """Functions of test modules are pickled by value, as those of the package are."""
    for name, module in list(sys.modules.items()):
        if name.startswith("test_"):
            cloudpickle.register_pickle_by_value(module)


@pytest.fixture(scope="session")
def spark(tmp_path_factory: pytest.TempPathFactory) -> SparkSession:
    from tidefold.session import get_spark

    session = get_spark(
        "tests",
        master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="3g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def scalars(spark: SparkSession):
    """A frame of (seq, x) from values in order."""

    def make(values: list, kind: str = "bigint"):
        return spark.createDataFrame(list(enumerate(values)), f"seq bigint, x {kind}")

    return make
