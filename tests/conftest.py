import faulthandler
import signal
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TEST_LIMIT_S = 300


@pytest.fixture(scope="session")
def spark():
    from airloom.session import session

    conf = {
        "spark.master": "local[4]",
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
    }
    s = session("tests", **conf)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def time_limit(spark):
    """A test that takes too long fails; one that blocks outside Python shows where."""

    def stop(*_):
        raise TimeoutError(f"over {TEST_LIMIT_S} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(TEST_LIMIT_S)
    faulthandler.dump_traceback_later(TEST_LIMIT_S + 30)
    yield
    faulthandler.cancel_dump_traceback_later()
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)
