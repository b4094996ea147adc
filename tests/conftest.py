import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tagloom.session import local_session

    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files_of(spark):
    """A file table from a dict of path -> code."""

    def build(files):
        return spark.createDataFrame(list(files.items()), "file_path string, code string")

    return build
