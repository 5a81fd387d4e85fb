import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from helixframe.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4, 4, **{"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.driver.memory": "4g", "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("checkpoints"))})
    ship(s)
    yield s
    s.stop()
