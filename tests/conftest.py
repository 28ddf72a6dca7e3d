import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def pytest_addoption(parser):
    parser.addoption("--all-twins", action="store_true", help="compare every query with its SQL twin")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from perfspark.runtime import session

    s = session("tests", **{
        "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
