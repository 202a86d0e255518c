import pytest

from ticketmill.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    settings = {
        "spark__ui__enabled": "false",
        "spark__ui__showConsoleProgress": "false",
        "spark__sql__shuffle__partitions": "4",
        "spark__sql__maxMetadataStringLength": "1000",
        "spark__checkpoint__dir": str(tmp_path_factory.mktemp("checkpoints")),
        "spark__sql__warehouse__dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    session = build_session("tests", "local[4]", **settings)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
