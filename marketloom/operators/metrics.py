"""Named metrics over fact tables, by dimensions and time grain.

A request is answered by one grouping per fact table. The grouped results are stacked and
grouped once more on the requested dimensions (so facts with different rows meet, NULL
dimension values included), and ratios and derived metrics are projections on top.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.scalars import exprs, mean_of, ratio
from marketloom.operators.numbering import join_null_safe

GRAINS = ("day", "week", "month", "quarter", "year")
TIME = "metric_time"


@dataclass(frozen=True)
class Entity:
    """A many-to-one link from a fact to a dimension table."""

    table: str
    local_key: str
    key: str


@dataclass(frozen=True)
class Fact:
    """A table metrics are computed from: its time column and its links."""

    time: str
    entities: Mapping[str, Entity] = field(default_factory=dict)


@dataclass(frozen=True)
class Simple:
    fact: str
    agg: str  # sum, count, average, or a whole aggregate expression
    expr: str = ""
    where: str | None = None

    def sql(self) -> str:
        value = f"CASE WHEN {self.where} THEN {self.expr} END" if self.where else self.expr
        if self.agg in ("sum", "count"):
            return f"{self.agg}({value})"
        if self.agg == "average":
            return mean_of(value)
        return self.agg


@dataclass(frozen=True)
class Ratio:
    top: str
    bottom: str


@dataclass(frozen=True)
class Derived:
    """Expression over metrics, written ``{metric}``; ``{metric@1}`` is its value one month earlier."""

    expr: str


Metric = Simple | Ratio | Derived

_FOREIGN = re.compile(r"\{(\w+)\.(\w+)\}")
_REFERENCE = re.compile(r"\{(\w+)(?:@(\d+))?\}")


def _truncated(column: str, grain: str) -> str:
    return column if grain == "day" else f"trunc({column}, '{grain}')"


def _column(name: str, months: int) -> str:
    return f"{name}__{months}_months_before" if months else name


class Metrics:
    def __init__(self, facts: Mapping[str, Fact], metrics: Mapping[str, Metric]):
        self.facts = facts
        self.metrics = metrics

    def _inputs(self, name: str, months: int = 0) -> set[tuple[str, int]]:
        """Simple metrics (with month offset) that ``name`` is made of."""
        metric = self.metrics[name]
        if isinstance(metric, Simple):
            return {(name, months)}
        if isinstance(metric, Ratio):
            return self._inputs(metric.top, months) | self._inputs(metric.bottom, months)
        found = set()
        for part, offset in _REFERENCE.findall(metric.expr):
            found |= self._inputs(part, months + int(offset or 0))
        return found

    def _sql(self, name: str, months: int = 0) -> str:
        metric = self.metrics[name]
        if isinstance(metric, Simple):
            return _column(name, months)
        if isinstance(metric, Ratio):
            return ratio(self._sql(metric.top, months), self._sql(metric.bottom, months))
        return _REFERENCE.sub(lambda m: f"({self._sql(m[1], months + int(m[2] or 0))})", metric.expr)

    def _grouped(
        self,
        tables: Mapping[str, DataFrame],
        fact: str,
        simple: Sequence[tuple[str, int]],
        group_by: Sequence[str],
        grain: str | None,
        where: str | None,
    ) -> DataFrame:
        """One fact grouped once; earlier values are the same groups moved forward in time."""
        spec, df = self.facts[fact], tables[fact]
        dims = [dim.rpartition(".")[2] for dim in group_by]
        # Columns of linked tables, grouped by or filtered on: one join per link.
        foreign = {tuple(dim.split(".")) for dim in group_by if "." in dim} | set(_FOREIGN.findall(where or ""))
        for owner in sorted({owner for owner, _ in foreign}):
            link = spec.entities[owner]
            taken = sorted(name for o, name in foreign if o == owner)
            side = tables[link.table].selectExpr(f"{link.key} AS _{owner}_key", *[f"{n} AS _{owner}_{n}" for n in taken])
            df = df.join(side, F.col(link.local_key) == F.col(f"_{owner}_key"), "left").drop(f"_{owner}_key")
        if where:
            df = df.filter(_FOREIGN.sub(r"_\1_\2", where))
        owned = [f"_{d.rpartition('.')[0]}_{n} AS {n}" if "." in d else n for d, n in zip(group_by, dims)]
        keys = exprs(*owned, *([f"{_truncated(spec.time, grain)} AS {TIME}"] if grain else []))
        names = sorted({name for name, _ in simple})
        now = df.groupBy(*keys).agg(*exprs(*[f"{self.metrics[n].sql()} AS {n}" for n in names]))
        keyed = [*dims, *([TIME] if grain else [])]
        current = [n for n, months in simple if not months]
        offsets = sorted({months for _, months in simple if months})
        if not offsets:
            return now.select(*keyed, *current)
        if grain not in ("month", "quarter", "year"):
            raise ValueError("a metric with a month offset needs a grain of at least a month")
        out = [now.selectExpr(*keyed, *current, "true AS _exists")]
        for months in offsets:
            later = f"{_truncated(f'add_months({TIME}, {months})', grain)} AS {TIME}"
            out.append(now.selectExpr(*dims, later, *[f"{n} AS {_column(n, m)}" for n, m in simple if m == months]))
        # Earlier values meet the period they belong to; periods that only have one are dropped.
        return _stack(out, keyed).filter("_exists").drop("_exists")

    def query(
        self,
        tables: Mapping[str, DataFrame],
        names: Sequence[str],
        group_by: Sequence[str] = (),
        grain: str | None = None,
        where: str | None = None,
        spine: DataFrame | None = None,
    ) -> DataFrame:
        """Metrics ``names`` per dimension (``column`` or ``entity.column``) and ``metric_time``.

        ``where`` filters the facts before grouping; ``{entity.column}`` stands for a column of a
        linked table. ``spine`` (a table of ``date_day``) adds the
        periods without any row; with dimensions, every combination of their values that has a row in some period
        unfolds all periods of the spine, without a join of the two.
        """
        if grain is not None and grain not in GRAINS:
            raise ValueError(f"grain must be one of {GRAINS}, got {grain!r}")
        needed = sorted(set().union(*[self._inputs(n) for n in names]))
        by_fact: dict[str, list[tuple[str, int]]] = {}
        for name, months in needed:
            by_fact.setdefault(self.metrics[name].fact, []).append((name, months))
        keys = [d.rpartition(".")[2] for d in group_by] + ([TIME] if grain else [])
        parts = [self._grouped(tables, f, simple, group_by, grain, where) for f, simple in by_fact.items()]
        result = _stack(parts, keys)
        if spine is not None:
            result = self._filled(result, keys[:-1], grain, spine)
        return result.selectExpr(*keys, *[f"{self._sql(n)} AS {n}" for n in names])


    @staticmethod
    def _filled(result: DataFrame, dims: Sequence[str], grain: str, spine: DataFrame) -> DataFrame:
        periods = spine.selectExpr(f"{_truncated('date_day', grain)} AS {TIME}").distinct()
        if not dims:
            return periods.join(result, TIME, "left")
        low, high = (spine.agg(F.expr(f"{end}({_truncated('date_day', grain)})")).scalar() for end in ("min", "max"))
        step = {"day": "1 day", "week": "7 days", "quarter": "3 months"}.get(grain, f"1 {grain}")
        every = F.explode(F.sequence(low, high, F.expr(f"interval {step}"))).alias(TIME)
        # Periods that the spine lacks between its ends are not filled.
        wanted = result.select(*dims).distinct().select("*", every).join(periods, TIME, "left_semi")
        return join_null_safe(wanted, result, [*dims, TIME])


def _stack(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Results with the same keys side by side. Every key is unique in each part."""
    if len(parts) == 1:
        return parts[0]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    values = [c for c in out.columns if c not in keys]
    return out.groupBy(*keys).agg(*exprs(*[f"max({c}) AS {c}" for c in values]))
