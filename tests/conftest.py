"""Fixtures of all tests; helpers are in ``helpers.py``."""

from __future__ import annotations

import time
import uuid
from pathlib import Path

import pytest
from helpers import as_value, at

from rtshop.schemas import RECORD
from rtshop.session import create_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = create_session(
        "rtshop-tests", master="local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="6g", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def records(spark):
    """Build a frame of records from messages, or from ``(message, seconds)`` pairs."""
    def build(messages, topic: str = "t", first_offset: int = 0):
        rows = []
        for i, message in enumerate(messages):
            message, seconds = message if isinstance(message, tuple) else (message, i)
            rows.append((None, as_value(message), topic, 0, first_offset + i, at(seconds)))
        return spark.createDataFrame(rows, RECORD)
    return build


@pytest.fixture(scope="session")
def write_file():
    """Write a frame as one file of a stream folder; later calls get later modification times."""
    def write(df, folder: str) -> None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        df.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return write


@pytest.fixture
def folder(tmp_path) -> str:
    return str(tmp_path / uuid.uuid4().hex)
