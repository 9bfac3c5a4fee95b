import os

import pytest


@pytest.fixture(scope="session")
def data():
    folder = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    return folder


@pytest.fixture(scope="session")
def larger():
    """Tables for what is learnt, where the smallest ones hold too few examples."""
    folder = os.environ.get("TIDEMARK_TEST_DATA_LARGE", "/root/testdata/sf0.01")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    return folder
