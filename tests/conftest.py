import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hitlens.session import checkpoint_dir, get_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", 4)
    checkpoint_dir(s)
    yield s


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="hitlens-test-")


def ts(*args, ms=0, us=0):
    return dt.datetime(*args) + dt.timedelta(milliseconds=ms, microseconds=us)


def hits_frame(spark, rows):
    """rows: (site_id, log_time, url, ip, agent)"""
    from hitlens import schemas
    data = [(s, str(i), t, u, ip, a) for i, (s, t, u, ip, a) in enumerate(rows)]
    return spark.createDataFrame(data, schemas.LOGS)
