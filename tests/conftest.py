import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from starboard.session import build_session

    folder = str(tmp_path_factory.mktemp("shared"))
    session = build_session(
        "tests",
        master="local[8]",
        shuffle_partitions=8,
        settings={
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": folder,
            "spark.sql.maxMetadataStringLength": "2000",
            "spark.sql.warehouse.dir": f"{folder}/tables",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "out")


def rows(df, *columns):
    """Rows as sorted tuples, NULLs first."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: [(v is not None, v) for v in r])


def final_plan(df):
    """The plan as it ran, without the expression ids."""
    import re

    df.collect()
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())
