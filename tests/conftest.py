import pytest

from corvella.session import get_spark


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = get_spark("local[8]", "tests", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__checkpoint__dir=f"file://{shared}", spark__sql__warehouse__dir=str(shared / "warehouse"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
