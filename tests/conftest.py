import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyscope.session import ensure_checkpoint_dir, local_session  # noqa: E402

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", partitions=8, app="tallyscope-tests")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def frame_0001(spark):
    from tallyscope.plans.prepare import analysis_frame

    return analysis_frame(spark, SF0001)
