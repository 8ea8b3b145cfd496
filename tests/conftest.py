import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ruleloom.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[4]", spark__sql__shuffle__partitions="4")
    s.sparkContext.environment["PYTHONPATH"] = str(Path(__file__).resolve().parents[1])
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
