import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tersely.session import session, ship

    base = tmp_path_factory.mktemp("spark")
    out = session(
        "local[4]",
        "tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(base / "warehouse"), "spark.checkpoint.dir": str(base / "checkpoints")},
    )
    out.sparkContext.setLogLevel("ERROR")
    yield ship(out)
    out.stop()
