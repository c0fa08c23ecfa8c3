import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from callytics.session import build_session
    from callytics.streaming.streams import STREAMING_SETTINGS

    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.python.unix.domain.socket.enabled": "true",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            **STREAMING_SETTINGS,
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
