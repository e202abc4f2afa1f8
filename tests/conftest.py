import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from churnspark.session import checkpoint_dir, get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", app_name="churnspark-tests", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    # tests only: the cluster names spark.checkpoint.dir; locally a fresh folder stands in
    checkpoint_dir(s, tempfile.mkdtemp(prefix="churnspark-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)
