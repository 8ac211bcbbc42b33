import os
import sys
import time

import pytest

# Naive datetimes in the fixtures are market time, as the session zone is.
os.environ["TZ"] = "Asia/Shanghai"
time.tzset()

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from tidemark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.sql.session.timeZone": "Asia/Shanghai"})
    session.sparkContext.setLogLevel("OFF")
    yield session


@pytest.fixture
def root(tmp_path):
    return str(tmp_path)
