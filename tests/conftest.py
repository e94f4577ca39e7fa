import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from recordqc.session import build_session
    # no coalescing: small inputs then really use several ranges
    s = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "6", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.log.level": "ERROR"})
    yield s
    s.stop()
