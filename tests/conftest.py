import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from marginalia.session import local_session

    return local_session("tests", cpus=8)


@pytest.fixture(scope="session")
def small():
    import oracle

    d = f"{oracle.ROOT}/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data here")
    return d


@pytest.fixture(scope="session")
def duck(small):
    import oracle

    return oracle.duck(small)
