import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import segtrans  # noqa: E402
import workload  # noqa: E402
from segtrans.session import get_session  # noqa: E402

segtrans.ship_by_value(segtrans)
segtrans.ship_by_value(workload)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g",
           "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture()
def strings(spark):
    """A one-column table of texts."""
    return lambda values, name="v": spark.createDataFrame([(v,) for v in values], f"{name} string")
