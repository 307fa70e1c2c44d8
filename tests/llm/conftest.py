import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def words_of():
    import re

    return lambda text: set(re.findall("[a-z0-9]+", (text or "").lower()))
