import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from textquern.session import get_session

    return get_session("local[4]", partitions=4, memory="3g")


DATA = "/root/testdata/sf0.001"
