import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from boxoffice.session import build_session  # noqa: E402
from tests.seed import seed_tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "boxoffice-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "2",
            "spark.default.parallelism": "1",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.host": "127.0.0.1",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="boxoffice-checkpoint-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def t(spark):
    return seed_tables(spark)
