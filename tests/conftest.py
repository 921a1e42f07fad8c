import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from gleaner.session import build_session

    s = build_session("tests", cpus=4, **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('checkpoints')}", "spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
