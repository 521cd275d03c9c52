import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

#: Fits of the tests: as the registered ones, but with fewer and smaller trees.
SMALL_FITS = {
    "resolution": {"max_iter": 5, "max_depth": 3}, "clusters": {"restarts": 2, "max_iter": 50},
    "classifier": {"trees": 5, "max_depth": 4, "max_terms": 100},
    "forest": {"trees": 10, "max_depth": 5, "max_terms": 100},
    "text": {"max_terms": 200, "regularisation": (0.01,), "max_iter": 10},
}


@pytest.fixture(scope="session")
def spark():
    from triagelens.plans import catalog
    from triagelens.session import local_session

    catalog.FIT_ARGS.update(SMALL_FITS)
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
