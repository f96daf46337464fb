import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lodestar.session import checkpoint_dir, get_spark

    s = get_spark(app="lodestar-tests", cpus="*", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s
    s.stop()
