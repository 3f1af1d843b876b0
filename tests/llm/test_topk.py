from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from marketloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k):
    import numpy as np

    whole = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows}
    out = []
    for q in whole:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), c) for c in whole if c != q and len(whole[c]) == len(whole[q]))
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_against_all_pairs_with_ties(table, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 64)
    monkeypatch.setattr(topk, "QUERIES", 4)
    r = random.Random(2)
    rows = [(i, [r.choice([-0.5, 0.0, 0.25, r.random()]) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(2000, [0.0] * 6), (2050, [1.0, 2.0]), (2051, [3.0, -1.0])]
    got = sorted(map(tuple, topk.top_k(table(SCHEMA, *rows), F.col("vec_id") % 50 == 0).collect()))
    assert got == brute(rows, 5)


def test_rows_that_take_no_part(table):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [0.5, 0.5]), (None, [9.0, 9.0]), (50, [])]
    got = [tuple(r) for r in topk.top_k(table(SCHEMA, *rows), F.col("vec_id") % 50 == 0).collect()]
    assert got == [(0, 1, 5, 256 * 128)]


def test_empty_repeated_and_clashing(table):
    df = table("vec_id long, embedding array<float>, id int, v int, score string")
    assert topk.top_k(df, F.col("vec_id") % 50 == 0).collect() == []
    df = table("vec_id long, embedding array<float>, id int, d string", (0, [1.0], 1, "a"), (0, [1.0], 2, "b"), (7, [2.0], 3, "c"), (8, [-1.0], 4, "d"))
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 7, 256 * 512), (0, 2, 8, -256 * 256)]
