"""The checks declared on the published tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.scalars import quoted
from marketloom.operators import checks

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Declared:
    """Checks of one table: keys, references and listed values."""

    not_null: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    unique_together: tuple[str, ...] = ()
    values: Mapping[str, tuple[str, ...]] | None = None
    references: Mapping[str, tuple[str, str]] | None = None


# Value lists of the coded columns.
STATUSES = ("COMPLETED", "RETURNED", "CANCELLED")
STAGES = ("active", "at_risk", "churned", "never_purchased")
TIERS = ("high_value", "mid_value", "low_value", "no_purchases")
ROAS_TIERS = ("high_performing", "efficient", "break_even", "underperforming")

DECLARED: dict[str, Declared] = {
    "dim_customers": Declared(
        ("customer_id",), ("customer_id",), values={"customer_lifecycle_stage": STAGES, "customer_value_tier": TIERS}
    ),
    "dim_stores": Declared(("store_id",), ("store_id",), values={"store_type": ("physical", "digital")}),
    "dim_dates": Declared(("date_day",), ("date_day",)),
    "fct_orders": Declared(
        ("order_id", "order_date", "customer_id", "store_id", "gross_revenue", "net_revenue"),
        ("order_id",),
        values={"order_status": STATUSES},
        references={"customer_id": ("dim_customers", "customer_id"), "store_id": ("dim_stores", "store_id")},
    ),
    "revenue_daily": Declared(("revenue_date", "store_id"), unique_together=("revenue_date", "store_id")),
    "customer_ltv": Declared(("customer_id",), ("customer_id",)),
    "cohort_analysis": Declared(("cohort_month", "retention_rate_pct")),
    "campaign_performance": Declared(
        ("campaign_id", "spend_date"), unique_together=("campaign_id", "spend_date"), values={"roas_tier": ROAS_TIERS}
    ),
}


def _row_rules(spec: Declared) -> dict[str, str]:
    rules = {f"{c}_not_null": checks.fails_not_null(c) for c in spec.not_null}
    return rules | {f"{c}_accepted_values": checks.fails_accepted_values(c, v) for c, v in (spec.values or {}).items()}


def _others(spec: Declared) -> dict[str, Callable[[DataFrame, Tables], DataFrame]]:
    out: dict[str, Callable[[DataFrame, Tables], DataFrame]] = {}
    for c in spec.unique:
        out[f"{c}_unique"] = lambda df, tables, c=c: checks.unique(df, c)
    if spec.unique_together:
        out["_".join(spec.unique_together) + "_unique"] = lambda df, tables: checks.unique_combination_of_columns(
            df, spec.unique_together
        )
    for c, (to, field) in (spec.references or {}).items():
        out[f"{c}_in_{to}"] = lambda df, tables, c=c, to=to, field=field: checks.relationships(df, c, tables[to], field)
    return out


def names() -> list[tuple[str, str]]:
    return [(t, c) for t, spec in DECLARED.items() for c in [*_row_rules(spec), *_others(spec)]]


def run(tables: Tables, only: tuple[str, ...] = tuple(DECLARED)) -> DataFrame:
    """One row per declared check. Row rules of a table share one pass."""
    parts = []
    for name in only:
        spec, df = DECLARED[name], tables[name]
        results = [checks.run_row_checks(df, _row_rules(spec))]
        results += [checks.verdict(check(df, tables), label) for label, check in _others(spec).items()]
        parts += [r.select(F.expr(f"{quoted(name)} AS table_name"), "check_name", "failures", "passed") for r in results]
    return reduce(DataFrame.unionByName, parts)
