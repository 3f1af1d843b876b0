"""Repairs against a search over all edit sequences, and rows that are odd."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marketloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, repaired lines) by the cheapest path over (rows used, initials so far), least audit first."""
    ends = re.compile(r"(s?(ua)+)?")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, used, initials, lines = heapq.heappop(heap)
        if used == len(rows) and ends.fullmatch(initials):
            return cost, audit, lines
        if (used, initials) in done or not re.fullmatch(r"s?(ua)*u?", initials) or len(initials) > len(rows) + 3:
            continue
        done.add((used, initials))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", used, initials + role[0], (*lines, f"{role}:")))
        if used < len(rows):
            role, text, fault = rows[used]
            heapq.heappush(heap, (cost + 3, audit + "D", used + 1, initials, lines))
            if fault in ("ok", "truncated"):
                cut = fault == "truncated"
                heapq.heappush(heap, (cost + cut, audit + "K", used + 1, initials + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    heapq.heappush(heap, (cost + cut + 2, audit + "R", used + 1, initials + other[0], (*lines, f"{other}:{text}")))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(key.encode()) % 20, role if role is not None else " ", text if text is not None else " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain(rows, convs):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, role, text))
    out = {}
    for conv in convs:
        same = lambda r: hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()
        told = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, same(r)))
        seen, marked = set(), []
        for _, role, text in told:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "ok" if shown[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, _, _ in told if t is not None]
        cost, audit, lines = cheapest(marked)
        faults = [f for _, _, f in marked]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False)),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def got(df):
    found = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: r[1:] for r in found}


def conversations(seed: int, count: int, most: int):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Who?", "a", "é. \n", "b."]
    return [
        (conv, rng.choice([None, *range(5)]) if rng.random() < 0.3 else turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts))
        for conv in range(count)
        for turn in range(rng.randint(0, most))
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_faults_against_a_search(table, seed):
    rows = conversations(seed, 150, 7)
    convs = {r[0] for r in rows}
    assert got(repair.damage_check(table(SCHEMA, *rows))) == plain(damage(rows), convs)


def test_a_system_turn_first_and_elsewhere(table):
    rows = [(k, t, role, f"{t}.") for k, roles in enumerate(["sua", "us", "s", "ssua", "uasua", "aus", "uaa", "ux"]) for t, role in enumerate(roles)]
    rows = [(k, t, {"s": "system", "u": "user", "a": "assistant", "x": "x"}[r], text) for k, t, r, text in rows]
    df = table(SCHEMA, *rows)
    found = got(repair.audits(repair._rows(df, "conv_id", "turn", "role", "text")))
    assert found == plain(rows, range(8))
    assert found[2][6] == "D" and found[1][6] == "KR"


def test_repaired_rows(table):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "cut"), (2, 0, "assistant", "A."), (2, 1, "user", "")]
    out = sorted(tuple(r) for r in repair.repaired(table(SCHEMA, *rows)).collect())
    assert out == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "cut"), (2, 0, "I", "user", ""), (2, 1, "K", "assistant", "A.")]


def test_nulls_ties_clashing_columns_and_a_long_text(table):
    rows = [
        (None, None, None, None),
        (None, None, "user", "A."),
        (None, 1, "user", "A."),
        (3, 5, "user", "x" * 2_000_000),
        (3, 5, "user", "b."),
        (3, 5, "user", "b."),
        (3, 9, "assistant", "c."),
    ]
    df = table(SCHEMA + ", conv long, same long, audit string, copies long, part int", *[(*r, 1, 2, "x", 3, 4) for r in rows])
    assert got(repair.damage_check(df)) == plain(damage(rows), {None, 3})


def test_empty_table(table):
    assert repair.damage_check(table(SCHEMA)).collect() == []


def test_conversations_that_lose_all_rows_stay(table):
    lost = [c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    found = got(repair.damage_check(table(SCHEMA, *[(c, 0, "user", "A.") for c in lost])))
    assert lost and set(found.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_a_hot_conversation_in_many_ranges(spark, table):
    """A conversation over several ranges has one signature in order, and turns at borders count once."""
    rows = [(7, t // 2, ("user", "assistant")[t % 2], f"{t}.") for t in range(3000)] + [(8, 0, "user", "A.")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        df = table(SCHEMA, *rows)
        found = repair.signatures(repair._rows(df, "conv_id", "turn", "role", "text")).orderBy("conv").collect()
        assert [len(r.signature) for r in found] == [3000, 1] and [r.gaps for r in found] == [0, 0]
        audits = repair.audits(repair._rows(df, "conv_id", "turn", "role", "text")).where("conv = 7").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(audits) == 1 and len(audits[0].audit) >= 3000


def test_nodes_are_shared_by_suffix(monkeypatch):
    import pyarrow as pa

    made, real = [], repair.prepended
    monkeypatch.setattr(repair, "prepended", lambda letter, rest: made.append(letter) or real(letter, rest))
    signatures = sorted({"BCBC", "ABCBC", "CBC", "BCBO"}, key=lambda s: s[::-1])
    list(repair._solve([pa.RecordBatch.from_pydict({"signature": signatures})]))
    assert len(made) == len({s[k:] for s in signatures for k in range(len(s))}) == 9


def test_damage_kinds_cover_all(table):
    rows = [(c, t, "assistant", "One. Two!") for c in range(60) for t in range(4)]
    out = repair.damaged(repair._rows(table(SCHEMA, *rows), "conv_id", "turn", "role", "text"))
    kept = sorted((r.conv, r.turn, r.role, r.text) for r in out.where(F.col("copies") > 0).collect() for _ in range(r.copies))
    assert kept == sorted(damage(rows))
