import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from propweave.session import get_session

    s = get_session("tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                    spark__ui__showConsoleProgress="false", spark__driver__memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def small_sample(monkeypatch):
    """Make even small tables take the bucketed path."""
    from propweave.operators import ordering

    monkeypatch.setattr(ordering, "SAMPLE", 8)


def rows(df):
    return sorted(tuple(r) for r in df.collect())
