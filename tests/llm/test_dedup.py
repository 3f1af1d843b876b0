from __future__ import annotations

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marketloom.llm import dedup
from tests.llm.brute import kept_copies

SCHEMA = "doc_id long, text string"


def found(df):
    return {r[0]: tuple(r)[1:] for r in dedup.exact_duplicates(df).collect()}


def test_white_space_null_and_empty(table):
    rows = [(5, "a  b"), (3, "a\t\n b"), (9, " a b"), (1, None), (2, ""), (4, " "), (7, "A b"), (8, "a\u00a0b")]
    assert found(table(SCHEMA, *rows)) == kept_copies(rows)


def test_hot_text_in_shares_and_long_texts(spark, table):
    random.seed(3)
    rows = [(i, "same old text" if i % 3 == 0 else random.choice(["x ", "y  ", "z\n"]) * (i % 50)) for i in range(3000)]
    rows += [(9000 + i, "long " * 30_000 + ("end" if i < 2 else "END")) for i in range(4)]
    assert found(table(SCHEMA, *rows).repartition(7)) == kept_copies(rows)


def test_null_and_repeated_ids(table):
    rows = [(None, "a"), (None, "a"), (2, "a"), (2, "a"), (None, "b"), (None, "b")]
    got = sorted(map(tuple, dedup.exact_duplicates(table(SCHEMA, *rows)).collect()), key=str)
    assert [r[3] for r in got if r[1] == 2] .count(True) == 1
    assert all(r[2] == 4 for r in got if r[1] == 2)
    assert sorted(r[3] for r in got if r[1] is None) == [False, True]


def test_empty_and_clashing_columns(spark, table):
    assert dedup.exact_duplicates(table(SCHEMA)).count() == 0
    df = table("doc_id long, text string, keep_id string, _sha int, _text int", (1, "a", "x", 1, 2), (2, "a", "y", 3, 4))
    assert found(df)[2][:3] == (1, 2, False)
    kept = dedup.without_duplicates(df)
    assert kept.columns == df.columns and [r[0] for r in kept.collect()] == [1]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB \t\n\u00e9", max_size=5), min_size=1, max_size=60))
def test_any_texts(table, texts):
    rows = list(enumerate(texts))
    assert found(table(SCHEMA, *rows)) == kept_copies(rows)
