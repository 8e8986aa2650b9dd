import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__ as entry

    session = entry.session("4")
    yield session
    session.stop()


@pytest.fixture
def tight(monkeypatch):
    """Nothing may be broadcast, every frequent key is hot: the paths for large data."""
    from sparkscrub.plans import sizing

    monkeypatch.setattr(sizing, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(sizing, "HOT_MIN_ROWS", 3)
