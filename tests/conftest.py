import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from spindrift.runtime import session

    s = session("tests", cpus=4, partitions=4, memory="4g")
    yield s
    s.stop()


def rows(df, *cols):
    """The rows as sorted tuples."""
    own = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in own.collect()), key=repr)


@pytest.fixture(scope="session")
def as_rows():
    return rows
