"""One local session for all tests, and the small test tables where they are present."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = os.environ.get("HEARTHMILL_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from hearthmill.session import build_session

    s = build_session("tests", "local[4]", 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("test tables are not here")
    return DATA


@pytest.fixture
def store(spark):
    from hearthmill.plans.store import TableStore
    from hearthmill.session import new_path

    return TableStore(spark, new_path(spark, "test-store"))


def rows(df, *order):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
