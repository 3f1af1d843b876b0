"""Run registered queries in Spark and DuckDB and compare the row multisets.

    python tests/oracle_compare.py [folder] [query …]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        path = pathlib.Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}") + 0.0
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in data)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    expected = rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns: spark only {sorted(set(df.columns) - set(names))}, sql only {sorted(set(names) - set(df.columns))}"
    actual = rows(df.columns, df.collect())
    same_kind = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = [(c, t, kinds[c]) for c, t in df.dtypes if same_kind.get(t) != kinds[c]]
    if odd:
        return f"types differ: {odd}"
    if actual != expected:
        missing, extra = list((expected - actual).items())[:2], list((actual - expected).items())[:2]
        return f"{sum(actual.values())} vs {sum(expected.values())} rows\n  sql   {missing}\n  spark {extra}\n  {sorted(names)}"
    return None


if __name__ == "__main__":
    from marketloom.registry import ORACLES, QUERIES
    from marketloom.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    con = duck(folder)
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            problem = compare(df, con, ORACLES[name]) if name in ORACLES else f"(no oracle, {df.count()} rows)"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        ok = problem is None or problem.startswith("(no")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} agree")
