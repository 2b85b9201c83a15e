import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from textpulse.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=2, memory="6g")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as plain tuples, sorted; floats rounded."""
    def collect(df, digits=6, ordered=False):
        def plain(v):
            return round(v, digits) + 0.0 if isinstance(v, float) else v
        out = [tuple(plain(v) for v in r) for r in df.collect()]
        return out if ordered else sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))
    return collect
