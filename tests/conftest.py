import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from glyphstream.session import get_session

    s = get_session(4, 4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")), spark__sql__adaptive__coalescePartitions__initialPartitionNum="4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
