import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from postline.session import local_session

    s = local_session(cpus=4, shuffle_partitions=4, app="postline-tests")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="postline-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="postline-test-")


def posting(**kw):
    base = dict(
        seq=1, title="", company="", location="", url="", source_name="", source_type="",
        description="", salary="", employment_type="", date_posted="",
    )
    base.update(kw)
    return base


POSTING_SCHEMA = (
    "seq long, title string, company string, location string, url string, source_name string, "
    "source_type string, description string, salary string, employment_type string, date_posted string"
)


def frame(spark, rows):
    return spark.createDataFrame([posting(**r) for r in rows], POSTING_SCHEMA)
