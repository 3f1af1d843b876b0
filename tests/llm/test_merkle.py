"""The manifest against trees built plainly, and rows that are odd."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest

from marketloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text) -> str:
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h("".join(enc(v) for v in (*row[:4], text)))


def climb(digests: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and each leaf's siblings by level."""
    paths, here, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for k, node in enumerate(here):
            run = node // 16 * 16
            paths[k].append(("".join(level[run:node]), "".join(level[node + 1 : run + 16])))
        level = [h("".join(level[k : k + 16])) for k in range(0, len(level), 16)]
        here = [node // 16 for node in here]
    return level[0], paths


def plain(rows):
    trees = defaultdict(list)
    for row in rows:
        text = row[4]
        if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
            text = "".join(c.lower() if c.isascii() else c for c in text)
        trees[row[1]].append((row[0], leaf(row, row[4]), leaf(row, text)))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = []
    for s in order:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        built.append(climb([x[1] for x in trees[s]]))
    root, above = climb([b[0] for b in built]) if built else ("", [])
    out = []
    for s, (subroot, paths), rest in zip(order, built, above, strict=True):
        for (i, own, presented), path in zip(trees[s], paths, strict=True):
            found = presented
            for left, right in path + rest:
                found = h(left + found + right)
            out.append((i, own, subroot, root, h("".join(a + b for a, b in path + rest)), found, found == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [16, 17, 1], [257, 3], [700, 256, 15, *[1] * 300]])
def test_trees_of_all_shapes(table, sizes):
    rows = [(k * 1000 + i, f"s{k}", "en", i, f"Text {i} of É{k}") for k, n in enumerate(sizes) for i in range(n)]
    assert got(merkle.tamper_check(table(SCHEMA, *rows))) == plain(rows)


def test_a_round_beyond_blocks_of_blocks(table, monkeypatch):
    """Small blocks reach several rounds up and down; the result does not depend on the block."""
    rows = [(i, "a" if i % 3 else "b", "en", 1, f"T{i}") for i in range(900)]
    assert merkle.BLOCK == 256
    frontier = merkle.Frontier(3)
    for i in range(900):
        frontier.append(h(str(i)))
    root, paths = climb([h(str(i)) for i in range(900)])
    assert frontier.root() == root and frontier.witness == paths
    assert got(merkle.tamper_check(table(SCHEMA, *rows))) == plain(rows)


def test_nulls_repeats_and_long_texts(table):
    rows = [
        (None, "a", None, None, None),
        (None, None, "en", 0, ""),
        (1, None, "en", 1, "A"),
        (1, None, "en", 1, "A"),
        (1, None, "en", 1, "B"),
        (2, "", None, 3, "x" * 3_000_000 + "Q"),
        (5, "a", "fr", 1, None),
        (0, "é", "fr", 1, "ÉABC"),
        (3, "z", "fr", 1, "-"),
    ]
    df = table(SCHEMA + ", root string, leaf long, tree long, pos long, size long, block long", *[(*r, "x", 1, 2, 3, 4, 5) for r in rows])
    assert got(merkle.tamper_check(df)) == plain(rows)


def test_empty_table(table):
    assert merkle.tamper_check(table(SCHEMA)).collect() == []


def test_proofs_fold_to_the_root(table):
    rows = [(i, f"s{i % 5 // 2}", "en", i, f"text {i}") for i in range(400)]
    for r in merkle.proofs(table(SCHEMA, *rows)).collect():
        found = r.leaf
        for left, right in zip(r.lefts, r.rights, strict=True):
            found = h(left + found + right)
        assert found == r.root and r.leaf == leaf(rows[r.doc_id], rows[r.doc_id][4])


def test_only_altered_rows_fail(table):
    rows = [(i, "s", "en", 1, "Capital" if i % 2 else "small") for i in range(200)]
    for r in merkle.tamper_check(table(SCHEMA, *rows)).collect():
        assert r.verified == (r.doc_id % 2 == 0 or zlib.crc32(str(r.doc_id).encode()) % 5 != 0)
