"""Data tests on tables. Each check returns its failing rows; ``verdict`` counts them.

Row-level checks of one table can be fused into a single pass with ``run_row_checks``. Checks
that look at neighbours or copies report a failing row once, with its number of ``copies``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions.scalars import exprs, quoted
from marketloom.operators.numbering import join_null_safe, with_next, with_previous


def _literal(value) -> str:
    if isinstance(value, str):
        return quoted(value)
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP'{value}'"
    if isinstance(value, dt.date):
        return f"DATE'{value}'"
    return str(value).lower() if isinstance(value, bool) else str(value)


def _listed(values: Sequence) -> str:
    return ", ".join(map(_literal, values))


# Predicates of failing rows, usable alone or fused.


def fails_not_null(column: str) -> str:
    return f"{column} IS NULL"


def fails_accepted_values(column: str, values: Sequence) -> str:
    return f"{column} NOT IN ({_listed(values)})"


def fails_not_accepted_values(column: str, values: Sequence) -> str:
    return f"{column} IN ({_listed(values)})"


def fails_range(column: str, min_value=None, max_value=None, inclusive: bool = True) -> str:
    """NULL passes."""
    eq = "=" if inclusive else ""
    parts = []
    if min_value is not None:
        parts.append(f"NOT ({column} >{eq} {_literal(min_value)})")
    if max_value is not None:
        parts.append(f"NOT ({column} <{eq} {_literal(max_value)})")
    return " OR ".join(parts) or "false"


def fails_expression(expression: str, column: str | None = None) -> str:
    """NULL passes."""
    return f"NOT ({column} {expression})" if column else f"NOT ({expression})"


def fails_not_empty_string(column: str, trim_whitespace: bool = True) -> str:
    return f"trim({column}) = ''" if trim_whitespace else f"{column} = ''"


def run_row_checks(df: DataFrame, checks: Mapping[str, str]) -> DataFrame:
    """Many row-level checks in one aggregate: one scan, one row per check."""
    counted = df.agg(*exprs(*[f"count_if({predicate}) AS `{name}`" for name, predicate in checks.items()]))
    return counted.unpivot([], [F.col(f"`{name}`") for name in checks], "check_name", "failures").withColumn(
        "passed", F.expr("failures = 0")
    )


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(fails_not_null(column))


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    bad = df.filter(fails_accepted_values(column, values))
    return bad.groupBy(F.expr(f"{column} AS value_field")).agg(F.expr("count(*) AS n_records"))


def not_accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(fails_not_accepted_values(column, values)).selectExpr(f"{column} AS value_field").distinct()


def accepted_range(df: DataFrame, column: str, min_value=None, max_value=None, inclusive: bool = True) -> DataFrame:
    return df.filter(fails_range(column, min_value, max_value, inclusive))


def expression_is_true(df: DataFrame, expression: str, column: str | None = None) -> DataFrame:
    return df.filter(fails_expression(expression, column))


def not_empty_string(df: DataFrame, column: str, trim_whitespace: bool = True) -> DataFrame:
    return df.filter(fails_not_empty_string(column, trim_whitespace))


def unique(df: DataFrame, column: str) -> DataFrame:
    return unique_combination_of_columns(df.filter(f"{column} IS NOT NULL"), [column])


def unique_combination_of_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.expr("count(*) AS n_records")).filter("n_records > 1")


def relationships(df: DataFrame, column: str, to: DataFrame, field: str) -> DataFrame:
    return relationships_where(df, column, to, field)


def relationships_where(
    df: DataFrame, column: str, to: DataFrame, field: str, from_condition: str = "true", to_condition: str = "true"
) -> DataFrame:
    """Values without a parent. An orphan value is one row with its number of records: child rows
    are counted per value before the join, so a value on a third of all rows travels once."""
    child = df.filter(f"{column} IS NOT NULL").filter(from_condition)
    child = child.groupBy(F.expr(f"{column} AS id")).agg(F.expr("count(*) AS n_records"))
    parent = to.filter(f"{field} IS NOT NULL").filter(to_condition).selectExpr(f"{field} AS id")
    return child.join(parent, "id", "left_anti")


def at_least_one(df: DataFrame, column: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Groups (or the whole table, also an empty one) without any value."""
    return df.groupBy(*group_by).agg(F.expr(f"count({column}) AS filler_column")).filter("filler_column = 0")


def not_constant(df: DataFrame, column: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Groups with exactly one distinct value. Smallest = largest value says the same as a distinct
    count of one, without a distinct aggregate."""
    seen = df.groupBy(*group_by).agg(*exprs(f"min({column}) AS low", f"max({column}) AS high"))
    return seen.filter("low = high").selectExpr(*group_by, "bigint(1) AS filler_column")


def not_null_proportion(
    df: DataFrame, column: str, at_least: float, at_most: float = 1.0, group_by: Sequence[str] = ()
) -> DataFrame:
    share = df.groupBy(*group_by).agg(F.expr(f"count({column}) / count(*) AS not_null_proportion"))
    return share.filter(f"not_null_proportion < {float(at_least)}D OR not_null_proportion > {float(at_most)}D")


def recency(
    df: DataFrame,
    field: str,
    datepart: str,
    interval: int,
    as_of: dt.datetime | dt.date,
    ignore_time_component: bool = False,
    group_by: Sequence[str] = (),
) -> DataFrame:
    """Groups whose newest ``field`` is older than ``as_of`` minus the interval."""
    kind = "date" if ignore_time_component else "timestamp"
    threshold = f"cast(timestampadd({datepart.upper()}, {-int(interval)}, timestamp({_literal(as_of)})) AS {kind})"
    newest = df.groupBy(*group_by).agg(F.expr(f"cast(max({field}) AS {kind}) AS most_recent"))
    return newest.selectExpr("*", f"{threshold} AS threshold").filter("most_recent < threshold")


def freshness(df: DataFrame, as_of: dt.datetime | dt.date, hours: int, loaded_at: str = "_loaded_at") -> DataFrame:
    """A source is stale if nothing was loaded during the last ``hours``."""
    return recency(df, loaded_at, "hour", hours, as_of)


def cardinality_equality(df: DataFrame, column: str, to: DataFrame, field: str) -> DataFrame:
    """Values whose number of rows differs, with the count of the side it comes from."""
    a = df.groupBy(F.expr(f"{column} AS value")).agg(F.expr("count(*) AS num_rows")).withColumn("in_a", F.lit(True))
    b = to.groupBy(F.expr(f"{field} AS value")).agg(F.expr("count(*) AS num_rows")).withColumn("in_a", F.lit(False))
    both = a.unionByName(b).groupBy("value", "num_rows").agg(*exprs("count(*) AS sides", "bool_or(in_a) AS in_a"))
    return both.filter("sides = 1").select("value", "num_rows", "in_a")


def _group_counts(a: DataFrame, b: DataFrame, group_by: Sequence[str]) -> DataFrame:
    """Row counts per group of both tables; a NULL group meets nothing."""
    groups = list(group_by)
    counted_a = a.withColumn("_all", F.lit(1)).groupBy("_all", *groups).agg(F.expr("count(*) AS count_a"))
    counted_b = b.withColumn("_all", F.lit(1)).groupBy("_all", *groups).agg(F.expr("count(*) AS count_b"))
    left = counted_a.selectExpr("_all", *[f"{g} AS {g}_a" for g in groups], "count_a")
    right = counted_b.selectExpr("_all AS _all_b", *[f"{g} AS {g}_b" for g in groups], "count_b")
    met = left["_all"] == right["_all_b"]
    for g in groups:
        met = met & (left[f"{g}_a"] == right[f"{g}_b"])
    return left.join(right, met, "full_outer").drop("_all", "_all_b")


def equal_rowcount(a: DataFrame, b: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Counts side by side; the verdict adds up ``diff_count`` (unmatched groups count 0)."""
    return _group_counts(a, b, group_by).selectExpr("*", "abs(count_a - count_b) AS diff_count")


def fewer_rows_than(a: DataFrame, b: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Counts side by side; the verdict adds up ``row_count_delta`` (equal counts fail by 1)."""
    delta = """CASE WHEN count_a > count_b THEN count_a - count_b WHEN count_a = count_b THEN bigint(1)
                    ELSE bigint(0) END AS row_count_delta"""
    return _group_counts(a, b, group_by).selectExpr("*", delta)


def _compared(df: DataFrame, columns: Sequence[str], precision: int | None) -> DataFrame:
    if precision is None:
        return df.select(*[F.col(f"`{c}`") for c in columns])
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FractionalType, T.DecimalType))}
    return df.selectExpr(
        *[f"round(cast(`{c}` AS decimal(38,12)), {precision}) AS `{c}`" if c in numeric else f"`{c}`" for c in columns]
    )


def equality(
    a: DataFrame,
    b: DataFrame,
    compare_columns: Sequence[str] | None = None,
    exclude_columns: Sequence[str] = (),
    precision: int | None = None,
) -> DataFrame:
    """Distinct rows found on one side only. Both set differences come from one grouping."""
    if compare_columns and exclude_columns:
        raise ValueError("give compare_columns or exclude_columns, not both")
    hidden = {c.lower() for c in exclude_columns}
    columns = list(compare_columns or [c for c in a.columns if c.lower() not in hidden])
    if not compare_columns and {c.lower() for c in columns} != {c.lower() for c in b.columns} - hidden:
        raise ValueError("the tables have different columns; list the ones to compare or exclude")
    left = _compared(a, columns, precision).selectExpr("*", "true AS _in_a", "false AS _in_b")
    right = _compared(b, columns, precision).selectExpr("*", "false AS _in_a", "true AS _in_b")
    sides = left.union(right).groupBy(*[F.col(f"`{c}`") for c in columns])
    found = sides.agg(*exprs("bool_or(_in_a) AS _in_a", "bool_or(_in_b) AS _in_b"))
    which = "CASE WHEN _in_a THEN 'a_minus_b' ELSE 'b_minus_a' END AS which_diff"
    return found.filter("_in_a <> _in_b").selectExpr(which, *[f"`{c}`" for c in columns])


_GAPS = {"not_allowed": "=", "allowed": "<=", "required": "<"}


def mutually_exclusive_ranges(
    df: DataFrame,
    lower: str,
    upper: str,
    partition_by: str | None = None,
    gaps: str = "allowed",
    zero_length_range_allowed: bool = False,
) -> DataFrame:
    """Ranges that are empty, reversed, or run into the next range of their partition.

    Ordered by (lower, upper), the next lower bound of a row is its own lower bound again, unless
    the row is the last of that lower bound; then it is the next distinct one. So only distinct
    lower bounds are walked, in value ranges, and no partition meets in one task. Rows without a
    lower bound fail by themselves and are not neighbours of others.
    """
    if gaps not in _GAPS:
        raise ValueError(f"gaps must be one of {sorted(_GAPS)}, got {gaps!r}")
    less = "<=" if zero_length_range_allowed else "<"
    group = ["partition_by_col"] if partition_by else []
    rows = df.selectExpr(
        *([f"{partition_by} AS partition_by_col"] if partition_by else []), f"{lower} AS lower_bound", f"{upper} AS upper_bound"
    )
    pairs = rows.groupBy(*rows.columns).agg(F.expr("count(*) AS n"))
    # Last row of a lower bound: the largest upper bound, an unknown one counting as largest.
    tops = pairs.groupBy(*group, "lower_bound").agg(
        F.expr("max(struct(upper_bound IS NULL AS open, upper_bound AS upper)) AS top")
    )
    walked = with_next(tops.filter("lower_bound IS NOT NULL"), "lower_bound", "next_distinct", group)
    joined = join_null_safe(pairs, walked, [*group, "lower_bound"])
    # A pair stands for n equal rows; only one row of the last pair sees the next distinct bound.
    is_top = "(upper_bound <=> top.upper)"
    split = joined.selectExpr(
        *group,
        "lower_bound",
        "upper_bound",
        "next_distinct",
        f"""inline(array(struct(false AS is_last_of_bound, n - int({is_top}) AS copies),
                         struct(true AS is_last_of_bound, bigint(int({is_top})) AS copies)))""",
    ).filter("copies > 0")
    checked = split.selectExpr(
        *group,
        "lower_bound",
        "upper_bound",
        "CASE WHEN is_last_of_bound THEN next_distinct ELSE lower_bound END AS next_lower_bound",
        f"coalesce(lower_bound {less} upper_bound, false) AS has_length",
        f"""CASE WHEN is_last_of_bound THEN coalesce(upper_bound {_GAPS[gaps]} next_distinct, next_distinct IS NULL)
                 ELSE coalesce(upper_bound {_GAPS[gaps]} lower_bound, false) END AS ends_before_next""",
        "copies",
    )
    return checked.filter("NOT (has_length AND ends_before_next)")


def sequential_values(
    df: DataFrame, column: str, interval: int = 1, datepart: str | None = None, group_by: Sequence[str] = ()
) -> DataFrame:
    """Values that do not follow their predecessor by ``interval``; the first one passes. A repeated
    value fails for every further copy."""
    present = df.filter(f"{column} IS NOT NULL")
    counted = present.groupBy(*group_by, column).agg(F.expr("count(*) AS n"))
    walked = with_previous(counted, column, "previous", group_by)
    if datepart:
        follows = f"timestamp({column}) = timestampadd({datepart.upper()}, {int(interval)}, timestamp(previous))"
    else:
        follows = f"{column} = previous + {interval}"
    failing = f"inline(array(struct(previous, bigint(NOT ({follows})) AS copies), struct({column} AS previous, n - 1 AS copies)))"
    return walked.selectExpr(*group_by, column, f"{failing} AS (previous_value, copies)").filter("copies > 0")


def verdict(failures: DataFrame, check_name: str) -> DataFrame:
    """One row: the check, its number of failures by the check's own rule, and whether it passed."""
    columns = failures.columns
    if "diff_count" in columns:
        count = "coalesce(sum(diff_count), 0)"
    elif "row_count_delta" in columns:
        count = "coalesce(sum(row_count_delta), 0)"
    elif "which_diff" in columns:
        count = "count(*) + abs(count_if(which_diff = 'a_minus_b') - count_if(which_diff = 'b_minus_a'))"
    elif "copies" in columns:
        count = "coalesce(sum(copies), 0)"
    else:
        count = "count(*)"
    counted = failures.agg(F.expr(f"bigint({count}) AS failures"))
    return counted.selectExpr(f"{quoted(check_name)} AS check_name", "failures", "failures = 0 AS passed")
