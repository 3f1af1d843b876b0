"""How pipelines find their inputs."""

from __future__ import annotations

import copy
import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame

Inputs = dict[str, DataFrame]


def use(inputs: Inputs, model: Callable[[Inputs, dt.date], DataFrame], as_of: dt.date) -> DataFrame:
    """The stored table of ``model`` if the caller supplies one, else its plan."""
    stored = inputs.get(model.__name__)
    return model(inputs, as_of) if stored is None else stored


def replaced(inputs: Inputs, **tables: DataFrame) -> Inputs:
    """The inputs with some tables exchanged or added (inputs read on demand stay so)."""
    out = copy.copy(inputs)
    out.update(tables)
    return out


def day(value: dt.date) -> str:
    return f"DATE'{value:%Y-%m-%d}'"


def built_at(as_of: dt.date) -> str:
    """Run time stamp: an input, never the clock, so that reruns give the same rows."""
    return f"timestamp({day(as_of)}) AS built_at"
