import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quern.session import session

    folder = tmp_path_factory.mktemp("spark")
    s = session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g",
        spark__sql__warehouse__dir=str(folder / "warehouse"), spark__checkpoint__dir=str(folder / "checkpoints"),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
