from __future__ import annotations

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from marketloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="6g"
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """``table("a int, b string", (1, "x"), …)``."""
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)


def rows(df, *columns):
    """Rows as a sorted list of tuples (NULLs first)."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: [(v is not None, str(type(v)), v) for v in r])
