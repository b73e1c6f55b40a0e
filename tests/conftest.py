import pytest

from lumigrid.session import local


@pytest.fixture(scope="session")
def spark():
    s = local(4, 4, **{"spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    return s
