import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from fleetsight.session import get_session

    extra = {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))}
    session = get_session("fleetsight-tests", "local[8]", 8, extra)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
