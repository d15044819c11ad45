import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from vacancy_spark.session import get_session
    s = get_session("local[*]", app_name="vacancy_spark_tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    # tests set their own shared folder only when the session names none
    if not s.conf.get("spark.checkpoint.dir", None):
        d = tempfile.mkdtemp(prefix="vacancy-tests-")
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    yield s
    s.stop()


@pytest.fixture()
def scratch(spark):
    from vacancy_spark.session import fresh_path
    return fresh_path(spark, "test")
