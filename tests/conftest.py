import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from stemsonde.session import build_session
    shared = os.environ.get("TEST_SHARED_DIR") or tempfile.mkdtemp(prefix="spark-")
    s = build_session("tests", master="local[8]", shuffle_partitions=8, shared=shared)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip(f"no test data at {SF}")
    return SF


def rows(df, *order):
    cols = order or df.columns
    return sorted([tuple(r[c] for c in cols) for r in df.select(*cols).collect()], key=str)
