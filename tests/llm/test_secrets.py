"""Spans against plain matching, queries against what they must not lose, and rows that are odd."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketloom.llm import secrets

SCHEMA = "doc_id long, text string"
PLAIN = {
    "assign": (re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile("[0-9a-f]+"), 0, 32),
}


def base_spans(text):
    """The contract's kinds, read without any index."""
    return [
        (m.start(), k, f"{kind}:{m.start()}:{m.end()}")
        for k, (kind, (pattern, group, least)) in enumerate(PLAIN.items())
        for m in pattern.finditer(text or "")
        if len(m[group]) >= least
    ]


def texts():
    rng = random.Random(3)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "APIKEY", "AKIA", "akia", '"', "'", " ", "  ", ":", "=", "é", "\n", "ABCDEFGH12345678"]
    parts += ["abcdef12", "0123456789abcdef" * 2, "deadbeef", "x", ".", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "ſecret=abcdefgh1", "toKen: abcdefgh1"]
    return [None, "", "a", "ab", *["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(600)]]


def test_base_spans_against_plain_matching(table):
    rows = list(enumerate(texts()))
    found = {r.doc_id: r for r in secrets.scan(table(SCHEMA, *rows).repartition(3)).collect()}
    assert len(found) == len(rows) and any(r.n_assign for r in found.values()) and any(r.n_access for r in found.values())
    for i, text in rows:
        spans = sorted(base_spans(text))
        told = ",".join(s for _, _, s in spans)
        r = found[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert ",".join(s for s in r.spans.split(",") if s.split(":")[0] in PLAIN) == told


def test_rules_beyond_the_base(table):
    text = "x -----BEGIN RSA PRIVATE KEY----- ghp_" + "aB3" * 12 + " https://me:hunter22@host sk_live_" + "w" * 24 + " AIza" + "z" * 35
    (r,) = secrets.scan(table(SCHEMA, (1, text))).collect()
    kinds = [s.split(":")[0] for s in r.spans.split(",")]
    assert kinds == ["private", "repository", "login", "payment", "maps"]
    assert r.base_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize(
    "pattern, texts",
    [
        ("abc|xyzw", ["zabc", "XYZW"]),
        ("ab[cd]e", ["abce", "abde"]),
        ("(?:foo|bar)+baz", ["foobarbaz"]),
        ("a{3}b?cd", ["aaacd", "aaabcd"]),
        ("x(?=yz)yz", ["xyz"]),
        ("(?i:key)[0-9]", ["KEY1", "Key1"]),
        ("(?i)straße", ["STRAßE"]),
        ("é{2}", ["éé"]),
        ("(a|)bcd", ["bcd", "abcd"]),
        ("[^a]bcd", ["ébcd"]),
        (".*", ["", "a"]),
        (r"\d{3}-\w+", ["123-a"]),
        ("^abc$", ["abc"]),
        ("(?:abc)*def", ["def", "abcdef"]),
        ("a[b-z]{1,2}cde", ["axcde"]),
    ],
)
def test_queries_keep_every_match(pattern, texts):
    query = secrets.trigram_query(pattern)
    needed = secrets._needed([query])
    for text in texts:
        if not re.search(pattern, text):
            continue
        assert list(secrets.search(query, secrets.index(pa.array(["", text]), needed), 2))[-1:] == [1]


def test_queries_of_the_rules():
    query = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert query["hex"] == secrets.EVERY and query["access"] == {frozenset([b"aki", b"kia"])}
    assert len(query["assign"]) == 6 and frozenset([b"tok", b"oke", b"ken"]) in query["assign"]
    assert [k for k, q in query.items() if q == secrets.EVERY] == ["hex"]


def test_posting_lists():
    texts = ["xAKIAx", None, "aki", "kia aki", "ak", "ia"]
    needed = secrets._needed([secrets.trigram_query("AKIA")])
    lists = secrets.index(pa.array(texts), needed)
    assert {k: v.tolist() for k, v in lists.items()} == {secrets._number(b"aki"): [0, 2, 3], secrets._number(b"kia"): [0, 3]}
    assert np.array_equal(secrets.search(secrets.trigram_query("AKIA"), lists, 6), [0, 3])


def test_the_stored_index_gives_the_candidates(table):
    rows = list(enumerate(texts()))
    index = secrets.postings(table(SCHEMA, *rows).repartition(4))
    found = {(r.kind, r.doc_id) for r in secrets.candidates(index, secrets.RULES).collect()}
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        low = [(i, secrets.lowered((t or "").encode())) for i, t in rows]
        assert {i for k, i in found if k == rule.kind} == {i for i, t in low if any(all(x in t for x in term) for term in query)}


def test_nulls_repeats_long_texts_and_clashing_columns(table):
    long = "lorem ipsum " * 200_000 + "password=abcdefgh1" + " dolor" * 200_000
    rows = [(None, "token=abcdefgh1"), (1, None), (1, "token=abcdefgh1"), (1, "token=abcdefgh1"), (2, long), (3, "")]
    df = table(SCHEMA + ", id long, spans string, n_hex string", *[(*r, 1, "x", "y") for r in rows])
    found = sorted(((r.doc_id, r.spans) for r in secrets.scan(df).collect()), key=str)
    at = long.index("password")
    assert found == sorted([(None, "assign:0:15"), (1, ""), (1, "assign:0:15"), (1, "assign:0:15"), (2, f"assign:{at}:{at + 18}"), (3, "")], key=str)


def test_empty_table(table):
    assert secrets.scan(table(SCHEMA)).collect() == []


def test_patterns_take_linear_time():
    import time

    began = time.time()
    for text in ("password " * 60_000, "token" + " " * 500_000, ".eyJ" * 120_000, "eyJ" * 150_000, "AKIA" * 120_000, "http://a:" * 60_000, "-----BEGIN " * 45_000):
        for r in secrets.RULES:
            secrets.spans_of(re.compile(r.pattern, re.ASCII), r.group, r.least, text)
    assert time.time() - began < 5


def test_one_pass_without_a_shuffle(table):
    plan = secrets.scan(table(SCHEMA, (1, "a")).where(F.col("doc_id") > 0))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
