import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tidemark.session import DEFAULT_CONF, ensure_checkpoint_dir

    b = SparkSession.builder.master("local[*]").appName("tidemark-tests")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    s = b.config("spark.sql.shuffle.partitions", "8").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tidemark-test-"))
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture
def scratch(spark):
    """A fresh folder under the session's checkpoint dir for one test."""
    import uuid

    from tidemark.session import scratch_path

    return scratch_path(spark, "tests", uuid.uuid4().hex)
