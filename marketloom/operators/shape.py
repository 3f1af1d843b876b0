"""Reshaping tables: spines, keys, duplicates, pivots, unions, profiles."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions.scalars import NULL_KEY_TOKEN, equal_width_bucket, surrogate_key

_STEPS = {
    "hour": ("interval 1 hour", "timestamp"),
    "day": ("interval 1 day", "date"),
    "week": ("interval 7 days", "date"),
    "month": ("interval 1 month", "date"),
    "quarter": ("interval 3 months", "date"),
    "year": ("interval 1 year", "date"),
}


def date_spine(spark: SparkSession, part: str, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """Column ``date_<part>`` from ``start`` up to, not including, ``end``."""
    if part not in _STEPS:
        raise ValueError(f"part must be one of {sorted(_STEPS)}, got {part!r}")
    step, kind = _STEPS[part]
    low, high = F.lit(str(start)).cast(kind), F.lit(str(end)).cast(kind)
    name = f"date_{part}"
    points = spark.range(1).select(F.explode(F.sequence(low, high, F.expr(step))).alias(name))
    return points.filter(F.col(name) < high)


def generate_series(spark: SparkSession, upper: int) -> DataFrame:
    return spark.range(1, upper + 1).select(F.col("id").alias("generated_number"))


def with_surrogate_key(
    df: DataFrame, columns: Sequence[str], name: str = "surrogate_key", nulls_as_empty: bool = False
) -> DataFrame:
    return df.withColumn(name, F.expr(surrogate_key(columns, "" if nulls_as_empty else NULL_KEY_TOKEN)))


def deduplicate(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column | str]) -> DataFrame:
    """First row of every group. Spark keeps one row per group in each map task before the
    shuffle (a group limit on the rank), so a heavy group does not travel."""
    window = Window.partitionBy(*partition_by).orderBy(*order_by)
    return df.withColumn("_place", F.row_number().over(window)).filter("_place = 1").drop("_place")


def pivot(
    df: DataFrame,
    group_by: Sequence[str],
    column: str,
    values: Sequence,
    agg: str = "sum",
    then_value: Column | str | int = 1,
    else_value: Column | int | None = 0,
    prefix: str = "",
    suffix: str = "",
    distinct: bool = False,
    cmp: str = "=",
) -> DataFrame:
    """One column per listed value, ``agg(when column <cmp> value then … else …)``, in one pass."""
    compare = {
        "=": lambda c, v: c == v,
        "!=": lambda c, v: c != v,
        "<": lambda c, v: c < v,
        "<=": lambda c, v: c <= v,
        ">": lambda c, v: c > v,
        ">=": lambda c, v: c >= v,
    }[cmp]
    functions = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max}
    if distinct:
        functions = {"sum": F.sum_distinct, "count": F.count_distinct}
    then = F.col(then_value) if isinstance(then_value, str) else F.lit(then_value)
    other = else_value if isinstance(else_value, Column) else F.lit(else_value)
    out = [
        functions[agg](F.when(compare(F.col(column), F.lit(v)), then).otherwise(other)).alias(f"{prefix}{v}{suffix}")
        for v in values
    ]
    return df.groupBy(*group_by).agg(*out)


def unpivot(
    df: DataFrame,
    keep: Sequence[str] = (),
    remove: Sequence[str] = (),
    cast_to: str = "string",
    field_name: str = "field_name",
    value_name: str = "value",
) -> DataFrame:
    """Columns to rows in one scan; names are matched without case, values cast to one type."""
    kept = {c.lower() for c in keep}
    dropped = kept | {c.lower() for c in remove}
    values = [c for c in df.columns if c.lower() not in dropped]
    ids = [c for c in df.columns if c.lower() in kept]
    cast = df.select(*[_quoted(c) for c in ids], *[_quoted(c).cast(cast_to).alias(c) for c in values])
    return cast.unpivot([_quoted(c) for c in ids], [_quoted(c) for c in values], field_name, value_name)


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def union_tables(
    tables: Mapping[str, DataFrame],
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    overrides: Mapping[str, str] | None = None,
    source_column: str | None = "source_table",
    where: str | None = None,
) -> DataFrame:
    """Stack tables with different columns: the union of all columns in order of appearance,
    NULL where a table lacks one, the first table's type (or the override) for all."""
    if include and exclude:
        raise ValueError("give include or exclude, not both")
    overrides = overrides or {}
    included, excluded = {c.lower() for c in include}, {c.lower() for c in exclude}
    types: dict[str, str] = {}
    for df in tables.values():
        for field in df.schema.fields:
            name = field.name.lower()
            if name in excluded or (included and name not in included):
                continue
            types.setdefault(field.name, overrides.get(field.name, field.dataType.simpleString()))
    if not types:
        raise ValueError("no columns left to union")
    parts = []
    for label, df in tables.items():
        rows = df.filter(where) if where else df
        columns = [
            (_quoted(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in types.items()
        ]
        source = [F.lit(label).alias(source_column)] if source_column else []
        parts.append(rows.select(*source, *columns))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def star(df: DataFrame, exclude: Sequence[str] = (), prefix: str = "", suffix: str = "") -> DataFrame:
    """All columns but ``exclude`` (matched without case), renamed with prefix and suffix."""
    hidden = {c.lower() for c in exclude}
    return df.select(*[_quoted(c).alias(f"{prefix}{c}{suffix}") for c in df.columns if c.lower() not in hidden])


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty strings become NULL in every text column."""
    return df.select(
        *[
            F.nullif(_quoted(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else _quoted(f.name)
            for f in df.schema.fields
        ]
    )


def column_values(
    df: DataFrame, column: str, where: str | None = None, max_records: int | None = None, ascending: bool = False
) -> DataFrame:
    """Distinct values with their frequency, most frequent first (ties by value)."""
    rows = df.filter(where) if where else df
    counted = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ordered = counted.orderBy(F.asc("n") if ascending else F.desc("n"), F.asc("value"))
    return ordered.limit(max_records) if max_records else ordered


def histogram(df: DataFrame, column: str, low: float, high: float, buckets: int) -> DataFrame:
    """Rows per equal-width bucket of ``column`` (0 below, ``buckets + 1`` at or above ``high``)."""
    bucket = F.expr(equal_width_bucket(column, low, high, buckets))
    return df.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min(column).alias("min_value"), F.max(column).alias("max_value")
    )
