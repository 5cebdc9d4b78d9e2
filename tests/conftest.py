import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
SF_BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quarry.session import get_spark
    wh = tmp_path_factory.mktemp("warehouse")
    s = get_spark("local[*]", app="quarry-tests", shuffle_partitions=8,
                  extra={"spark.sql.warehouse.dir": str(wh),
                         "spark.checkpoint.dir": str(tmp_path_factory.mktemp("ckpt"))})
    yield s
    s.stop()
