import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("PYTHONPATH", ROOT)


@pytest.fixture(scope="session")
def spark():
    from newsdigest.session import build_session
    s = build_session("local[4]", app="newsdigest-tests", shuffle_partitions=4,
                      extra={"spark.driver.memory": "6g"})
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="nd-test-ckpt-"))
    yield s
    s.stop()


def one_col(spark, values, col="x", typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"{col} {typ}")
