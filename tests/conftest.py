import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quire.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Apply a column function to a list of strings and return the results in order."""
    from pyspark.sql import functions as F

    def apply(fn, values):
        df = spark.createDataFrame(list(enumerate(values)), "i int, text string").repartition(4)
        rows = df.select("i", fn(F.col("text")).alias("out")).collect()
        return [r["out"] for r in sorted(rows, key=lambda r: r["i"])]

    return apply
