from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from turnlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "turnlake-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.streaming.stateStore.maintenanceInterval": "600s",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate a Column over literal inputs and return the Python value."""
    from pyspark.sql import functions as F

    def run(build, *inputs):
        columns = [F.col(f"c{i}") for i in range(len(inputs))]
        fields = ", ".join(f"c{i} {_type(x)}" for i, x in enumerate(inputs))
        row = spark.createDataFrame([tuple(inputs)], fields)
        return row.select(build(*columns).alias("v")).first()["v"]

    def _type(x):
        return {bool: "boolean", int: "bigint", float: "double"}.get(type(x), "string")

    return run
