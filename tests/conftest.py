import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("BASIN_TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from basin.session import get_session
    s = get_session("local[8]", shuffle_partitions=8,
                    conf={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="basin-wh-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)
