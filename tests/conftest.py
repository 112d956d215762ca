import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from panelforge.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def small_segments(spark):
    """Cut keys after a few rows, so the path of the large keys runs."""
    spark.conf.set("panelforge.segmentRows", "15")
    yield
    spark.conf.unset("panelforge.segmentRows")
