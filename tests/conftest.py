"""One local session for all tests, and where the driver's tables are."""

from __future__ import annotations

import os

import pytest

from tidegauge.session import session

DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = session(
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=f"file://{shared}",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def larger():
    return f"{DATA}/sf0.01"


@pytest.fixture(scope="session")
def largest():
    return f"{DATA}/sf0.1"
