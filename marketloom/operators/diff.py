"""Comparing two tables: rows, columns, keys.

Both sides are tagged, stacked and grouped instead of joined, so equal rows and repeated keys
collapse map-side and no key ever produces pairs. Where a comparison is defined over pairs of
rows with one key, the pairs are counted (n_a × n_b), not built.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions.scalars import exprs, quoted, surrogate_key
from marketloom.operators.numbering import join_null_safe

# Fixed value: the text that stands for NULL inside a hashed key of a comparison.
NULL_KEY_TOKEN = "_dbt_audit_helper_surrogate_key_null_"
# Copies of one row that one task unfolds.
COPIES_IN_PART = 10_000


def _q(c: str) -> str:
    return f"`{c}`"


def shared_columns(a: DataFrame, b: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    theirs, hidden = {c.lower() for c in b.columns}, {c.lower() for c in exclude}
    return [c for c in a.columns if c.lower() in theirs and c.lower() not in hidden]


def with_keys(keys: Sequence[str], columns: Sequence[str]) -> list[str]:
    """Compared columns with all key columns among them."""
    have = {c.lower() for c in columns}
    return [k for k in keys if k.lower() not in have] + list(columns)


def common_bounds(a: DataFrame, b: DataFrame, event_time: str) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to the time span they share, to nothing if one has none. The bounds are scalar subqueries."""
    first, last = ([df.agg(F.expr(f"{bound}({event_time})")).scalar() for df in (a, b)] for bound in ("min", "max"))
    # Without a NULL check an empty side would leave the other side its own bounds.
    low = F.when(first[0].isNotNull() & first[1].isNotNull(), F.greatest(*first))
    high = F.when(last[0].isNotNull() & last[1].isNotNull(), F.least(*last))
    return tuple(df.filter(F.col(event_time).between(low, high)) for df in (a, b))


def _stacked(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    names = [_q(c) for c in columns]
    left = a.selectExpr(*names, "1 AS in_a", "0 AS in_b")
    return left.union(b.selectExpr(*names, "0 AS in_a", "1 AS in_b"))


def _found(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows with the sides they are on."""
    return (
        _stacked(a, b, columns)
        .groupBy(*map(_q, columns))
        .agg(*exprs("max(in_a) = 1 AS in_a", "max(in_b) = 1 AS in_b"))
    )


def compare_rows(a: DataFrame, b: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Number and share of distinct rows in both, only in ``a``, only in ``b``."""
    counted = _found(a, b, _all_but(a, exclude)).groupBy("in_a", "in_b").agg(F.expr("count(*) AS count"))
    # At most three rows from here on.
    share = "round(100.0 * count / sum(count) OVER (), 2) AS percent_of_total"
    return counted.selectExpr("in_a", "in_b", "count", share).orderBy(F.desc("in_a"), F.desc("in_b"))


def row_differences(
    a: DataFrame, b: DataFrame, exclude: Sequence[str] = (), order_by: Sequence[str] = (), limit: int | None = None
) -> DataFrame:
    """Distinct rows on one side only. Sorted only if asked for, by ``order_by`` or a limit."""
    columns = _all_but(a, exclude)
    differing = _found(a, b, columns).filter("in_a <> in_b").select(*map(_q, columns), "in_a", "in_b")
    if order_by or limit:
        differing = differing.orderBy(*map(_q, order_by), F.desc("in_a"), F.desc("in_b"), *map(_q, columns))
    return differing.limit(limit) if limit else differing


def _all_but(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    hidden = {c.lower() for c in exclude}
    return [c for c in df.columns if c.lower() not in hidden]


# Column comparison. A state describes one pair of rows with the same key, or one unpaired row.
_FLAGS = {
    "perfect_match": ["match", "both_null"],
    "null_in_a": ["both_null", "null_a", "only_a_null"],
    "null_in_b": ["both_null", "null_b", "only_b_null"],
    "missing_from_a": ["only_b", "only_b_null", "keyless", "keyless_null"],
    "missing_from_b": ["only_a", "only_a_null", "keyless", "keyless_null"],
    "conflicting_values": ["null_a", "null_b", "conflict"],
}


def _single_state(c: str) -> str:
    a, b = f"a_row.{_q(c)}", f"b_row.{_q(c)}"
    return f"""CASE WHEN n_b = 0 THEN if({a} IS NULL, 'only_a_null', 'only_a')
                    WHEN n_a = 0 THEN if({b} IS NULL, 'only_b_null', 'only_b')
                    WHEN {a} = {b} THEN 'match'
                    WHEN {a} IS NULL AND {b} IS NULL THEN 'both_null'
                    WHEN {a} IS NULL THEN 'null_a' WHEN {b} IS NULL THEN 'null_b' ELSE 'conflict' END"""


def _alike(df: DataFrame, other: DataFrame, columns: Sequence[str]) -> str:
    """The compared columns as one struct, so that equal values are the same value however they are compared:
    both sides have the common type, and a zero has no sign."""
    names = [_q(c) for c in columns]
    common = df.selectExpr(*names).limit(0).union(other.selectExpr(*names).limit(0)).schema
    parts = []
    for c, field in zip(columns, common.fields, strict=True):
        kind = field.dataType
        value = _q(c) if df.schema[c].dataType == kind else f"cast({_q(c)} AS {kind.simpleString()})"
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            value = f"{value} + cast(0 AS {kind.simpleString()})"
        parts.append(f"{value} AS {_q(c)}")
    return f"struct({', '.join(parts)})"


def _column_states(
    a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], keys_are_unique: bool = False
) -> DataFrame:
    """(primary_key, column_name, state, row_count) for every key and column.

    Keys with at most one row per side are compared in place. Repeated and NULL keys go through
    counts per (key, column, value). ``keys_are_unique`` leaves that second path out.
    """
    left = a.selectExpr(f"{key} AS primary_key", f"{_alike(a, b, columns)} AS a_row", "1 AS in_a", "0 AS in_b")
    right = b.selectExpr(f"{key} AS primary_key", f"{_alike(b, a, columns)} AS b_row", "0 AS in_a", "1 AS in_b")
    stacked = left.unionByName(right, allowMissingColumns=True)
    sizes = exprs("sum(in_a) AS n_a", "sum(in_b) AS n_b")
    special = "primary_key IS NULL OR n_a > 1 OR n_b > 1"

    wide = stacked.groupBy("primary_key").agg(*sizes, *exprs("any_value(a_row, true) AS a_row", "any_value(b_row, true) AS b_row"))
    entries = ", ".join(f"struct({quoted(c)} AS column_name, {_single_state(c)} AS state)" for c in columns)
    single = wide.filter(f"NOT ({special})").selectExpr("primary_key", f"inline(array({entries}))", "bigint(1) AS row_count")
    if keys_are_unique:
        return single

    keys = stacked.groupBy("primary_key").agg(*sizes).filter(special).selectExpr("primary_key AS special_key", "n_a", "n_b")
    values = ", ".join(
        f"struct({quoted(c)} AS column_name, string(coalesce(a_row.{_q(c)}, b_row.{_q(c)})) AS value)" for c in columns
    )
    repeated = stacked.join(keys, stacked.primary_key.eqNullSafe(keys.special_key)).selectExpr(
        "primary_key", "n_a", "n_b", "in_a", "in_b", f"inline(array({values}))"
    )
    per_value = repeated.groupBy("primary_key", "n_a", "n_b", "column_name", "value").agg(*exprs("sum(in_a) AS a", "sum(in_b) AS b"))
    per_column = per_value.groupBy("primary_key", "n_a", "n_b", "column_name").agg(
        *exprs(
            "sum(CASE WHEN value IS NOT NULL THEN a * b ELSE 0 END) AS equal",
            "sum(CASE WHEN value IS NULL THEN a ELSE 0 END) AS null_a",
            "sum(CASE WHEN value IS NULL THEN b ELSE 0 END) AS null_b",
        )
    )
    counts = {
        "keyless_null": "primary_key IS NULL, null_a + null_b",
        "keyless": "primary_key IS NULL, n_a - null_a + n_b - null_b",
        "only_a_null": "primary_key IS NOT NULL AND n_b = 0, null_a",
        "only_a": "primary_key IS NOT NULL AND n_b = 0, n_a - null_a",
        "only_b_null": "primary_key IS NOT NULL AND n_a = 0, null_b",
        "only_b": "primary_key IS NOT NULL AND n_a = 0, n_b - null_b",
        "match": "primary_key IS NOT NULL, equal",
        "both_null": "primary_key IS NOT NULL, null_a * null_b",
        "null_a": "primary_key IS NOT NULL, null_a * (n_b - null_b)",
        "null_b": "primary_key IS NOT NULL, null_b * (n_a - null_a)",
        "conflict": "primary_key IS NOT NULL, (n_a - null_a) * (n_b - null_b) - equal",
    }
    states = ", ".join(f"struct({quoted(s)} AS state, if({condition_and_count}, bigint(0)) AS row_count)" for s, condition_and_count in counts.items())
    many = per_column.selectExpr("primary_key", "column_name", f"inline(array({states}))").filter("row_count > 0")
    return single.unionByName(many)


def column_flags(
    a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], keys_are_unique: bool = False
) -> DataFrame:
    """Six flags per key and column. ``row_count`` is 1 unless a key repeats; then it is the number
    of row pairs with these flags."""
    flags = [f"state IN ({', '.join(map(quoted, states))}) AS {flag}" for flag, states in _FLAGS.items()]
    return (
        _column_states(a, b, key, columns, keys_are_unique)
        .selectExpr("primary_key", "column_name", *flags, "row_count")
        .groupBy("primary_key", "column_name", *_FLAGS)
        .agg(F.expr("sum(row_count) AS row_count"))
    )


def compare_column(
    a: DataFrame,
    b: DataFrame,
    key: str,
    column: str,
    a_name: str = "a",
    b_name: str = "b",
    emojis: bool = True,
    keys_are_unique: bool = False,
) -> DataFrame:
    """Match states of one column with counts and shares."""
    yes, what, no = ("✅: ", "🤷: ", "❌: ") if emojis else ("", "", "")
    texts = {
        f"{yes}perfect match": ["match"],
        f"{yes}both are null": ["both_null", "only_a_null", "only_b_null", "keyless_null"],
        f"{what}missing from {a_name}": ["only_b", "keyless"],
        f"{what}missing from {b_name}": ["only_a"],
        f"{what}value is null in {a_name} only": ["null_a"],
        f"{what}value is null in {b_name} only": ["null_b"],
        f"{no}values do not match": ["conflict"],
    }
    arms = [
        f"WHEN state IN ({', '.join(map(quoted, states))}) THEN struct({i} AS place, {quoted(text)} AS text)"
        for i, (text, states) in enumerate(texts.items())
    ]
    counted = (
        _column_states(a, b, key, [column], keys_are_unique)
        .groupBy(F.expr(f"CASE {' '.join(arms)} END AS status"))
        .agg(F.expr("sum(row_count) AS count_records"))
    )
    # At most seven rows from here on.
    return counted.orderBy("status.place").selectExpr(
        f"{quoted(column)} AS column_name",
        "status.text AS match_status",
        "count_records",
        "round(100.0 * count_records / sum(count_records) OVER (), 2) AS percent_of_total",
    )


def compare_all_columns(
    a: DataFrame,
    b: DataFrame,
    key: str,
    exclude: Sequence[str] = (),
    summarize: bool = True,
    keys_are_unique: bool = False,
) -> DataFrame:
    """All columns at once: counts per column, or flags per key and column. ``key`` is any
    expression over the columns."""
    columns = _all_but(a, exclude)
    if not summarize:
        return column_flags(a, b, key, columns, keys_are_unique).withColumn("column_name", F.upper("column_name"))
    # Counts per column need no rows per key and column: states are counted in the map task.
    states = _column_states(a, b, key, columns, keys_are_unique).groupBy(F.upper("column_name").alias("column_name"))
    return states.agg(
        *exprs(*[f"bigint(sum(if(state IN ({', '.join(map(quoted, found))}), row_count, 0))) AS {flag}" for flag, found in _FLAGS.items()])
    )


def classify_rows(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
    event_time: str | None = None,
    sample_limit: int | None = None,
) -> DataFrame:
    """Rows as identical, modified, added, removed or nonunique_pk, with the size of each class.

    Equal rows are first collapsed to one with its number of copies per side; a key is unique
    if neither side has it twice. The size of a class counts keys (copies of repeated keys: the
    larger side). All rows are returned, copies of a row spread over tasks. ``sample_limit`` asks
    for the first rows of each class by key; Spark limits the rank inside every map task first.
    """
    columns = with_keys(keys, columns if columns is not None else shared_columns(a, b))
    if event_time:
        a, b = common_bounds(a, b, event_time)
    names, key_names = [_q(c) for c in columns], [_q(k) for k in keys]
    rows = _stacked(a, b, columns).groupBy(*names).agg(*exprs("sum(in_a) AS a", "sum(in_b) AS b"))
    # Grouping by the key columns themselves treats NULL as a value, as the hashed key does.
    per_key = rows.groupBy(*key_names).agg(*exprs("sum(a) AS n_a", "sum(b) AS n_b", "max(least(a, b)) AS both"))
    status = """CASE WHEN n_a > 1 OR n_b > 1 THEN 'nonunique_pk' WHEN {identical} THEN 'identical'
                     WHEN n_a = 1 AND n_b = 1 THEN 'modified' WHEN n_a = 1 THEN 'removed' ELSE 'added' END AS row_status"""
    classified = join_null_safe(rows, per_key, keys).selectExpr("*", status.format(identical="a = 1 AND b = 1"))

    # Class sizes come from the keys alone.
    sizes = (
        per_key.selectExpr(status.format(identical="both = 1"), "greatest(n_a, n_b) AS n")
        .groupBy("row_status")
        .agg(F.expr("sum(n) AS num_rows_in_status"))
    )

    key = surrogate_key(key_names, NULL_KEY_TOKEN)
    out = [
        *names,
        f"{key} AS row_key",
        "copy_number",
        "copy_number <= a AS in_a",
        "copy_number <= b AS in_b",
        "row_status",
    ]
    copies = "greatest(a, b)"
    if sample_limit:
        few = f"explode(sequence(1L, least({copies}, {int(sample_limit)}L))) AS copy_number"
        # Rows of a unique key share one place; rows of a repeated key are told apart.
        place = f"CASE WHEN row_status = 'nonunique_pk' THEN {_fingerprint(columns)} ELSE 0L END AS row_place"
        by_key = Window.partitionBy("row_status").orderBy("row_key", "row_place", "copy_number")
        sampled = (
            classified.selectExpr("*", few)
            .selectExpr(*out, place)
            .withColumn("sample_number", F.dense_rank().over(by_key))
            .filter(f"sample_number <= {int(sample_limit)}")
            .drop("row_place")
        )
    else:
        # Copies of a row unfold part by part, the parts spread over tasks.
        sampled = (
            classified.selectExpr("*", f"explode(sequence(0L, ({copies} - 1) DIV {COPIES_IN_PART})) AS part")
            .repartition(*key_names, "part")
            .selectExpr("*", f"explode(sequence(part * {COPIES_IN_PART} + 1, least({copies}, (part + 1) * {COPIES_IN_PART}))) AS copy_number")
            .selectExpr(*out)
        )
    return sampled.join(F.broadcast(sizes), "row_status")  # five classes at most


def _fingerprint(columns: Sequence[str], seed: int = 0) -> str:
    """Hash of a row that tells NULL positions apart (the hash function alone skips NULLs)."""
    parts = ", ".join(f"{_q(c)}, {_q(c)} IS NULL" for c in columns)
    return f"xxhash64({seed}, {parts})"


def which_columns_differ(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
    event_time: str | None = None,
) -> DataFrame:
    """For every column: does any key on both sides carry different values?

    For one key, some row of ``a`` differs from some row of ``b`` exactly if the values of both
    sides together are not all the same, which is a matter of smallest, largest and NULLs.
    """
    columns = with_keys(keys, columns if columns is not None else shared_columns(a, b))
    if event_time:
        a, b = common_bounds(a, b, event_time)
    stacked = _stacked(a, b, columns)
    text = {f.name for f in stacked.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))}

    def varies(c: str) -> str:
        # Two hashes stand for a text value: fixed-size buffers keep this a hash aggregate.
        images = [f"xxhash64({_q(c)})", f"hash({_q(c)})"] if c in text else [_q(c)]
        return " OR ".join(f"min({image}) <> max({image})" for image in images)

    differs = {c: f"(count({_q(c)}) > 0 AND (count({_q(c)}) < count(*) OR {varies(c)}))" for c in columns}
    per_key = stacked.groupBy(*map(_q, keys)).agg(
        *exprs("max(in_a) + max(in_b) = 2 AS on_both", *[f"{test} AS `d_{c}`" for c, test in differs.items()])
    )
    found = per_key.filter("on_both").agg(*exprs(*[f"bool_or(`d_{c}`) AS {_q(c)}" for c in columns]))
    return found.unpivot([], [F.col(_q(c)) for c in columns], "column_name", "has_difference")


def table_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and two order-free hash sums (copies add up, so duplicates count)."""
    sums = [f"sum(cast({_fingerprint(columns, seed)} AS decimal(38,0))) AS h{seed}" for seed in (1, 2)]
    return df.agg(*exprs("count(*) AS n", *sums))


def tables_identical(
    a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None, event_time: str | None = None
) -> DataFrame:
    """One row: are the tables the same multiset of rows?"""
    columns = list(columns or shared_columns(a, b))
    if event_time:
        a, b = common_bounds(a, b, event_time)
    both = table_fingerprint(a, columns).unionByName(table_fingerprint(b, columns))
    same = " AND ".join(f"(min({c}) <=> max({c}) AND count({c}) IN (0, 2))" for c in ("n", "h1", "h2"))
    return both.agg(F.expr(f"{same} AS are_tables_identical"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counted = [df.agg(F.expr("count(*) AS total_records")).selectExpr(f"{quoted(name)} AS relation_name", "total_records") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counted)
