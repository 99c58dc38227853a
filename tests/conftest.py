import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from corpusflow.session import build_session, checkpoint_dir
    s = build_session("local[4]", app="corpusflow-tests", shuffle_partitions=4)
    checkpoint_dir(s)  # local scratch folder: tests only
    yield s
    s.stop()
