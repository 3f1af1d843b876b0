from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from marketloom.llm import ngram_join
from marketloom.llm import words as W
from marketloom.llm.graph import components
from tests.llm.brute import near_components, shingle_set

SCHEMA = "doc_id long, text string"


def found(df):
    return {r[0]: (r[1], r[2]) for r in ngram_join.near_duplicates(df).collect()}


def copies(seed: int, groups: int, most: int, sizes: tuple[int, ...]) -> list[str]:
    """Groups of texts with a few words changed, at both sides of the threshold."""
    r = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{r.randint(0, 5000)}" for _ in range(r.choice(sizes))]
        for _ in range(r.randint(1, most)):
            text = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                text[r.randrange(len(text))] = f"v{r.randint(0, 10**6)}"
            out.append(" ".join(text[: len(text) - r.choice([0, 0, 1, 2])]))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("sizes", [(3, 9, 10, 11, 12, 13, 20, 30), (40, 60, 61, 90, 200, 400)])
def test_against_all_pairs(table, sizes):
    rows = list(enumerate(copies(sum(sizes), 60, 8, sizes)))
    assert found(table(SCHEMA, *rows).repartition(5)) == near_components(rows)


def test_large_group_in_blocks(table, monkeypatch):
    """One group of near copies, whose lists are cut into many blocks, and a passage in many other texts."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    r = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    texts = []
    for _ in range(150):
        text = list(base)
        for _ in range(r.choice([0, 1, 1, 2])):
            text[r.randrange(60)] = f"c{r.randint(0, 10**6)}"
        texts.append(" ".join(text))
    passage = " ".join(f"p{k}" for k in range(50))
    texts += [f"{passage} " + " ".join(f"q{r.randint(0, 10**6)}" for _ in range(r.randint(1, 40))) for _ in range(150)]
    rows = list(enumerate(texts))
    assert found(table(SCHEMA, *rows).repartition(3)) == near_components(rows)


def test_edge_cases(table):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "a b"), (7, "A  B"), (8, "b a"), (9, "a b c"), (10, "a b c d")]
    rows += [(11, " ".join(f"k{i}" for i in range(11))), (12, " ".join(f"k{i}" for i in range(12))), (13, "\u00c9a \u00e9a x"), (14, "\u00e9a \u00e9a x")]
    rows += [(15, "long " * 20_000 + "x"), (16, "long " * 20_000 + "y"), (17, " ".join(f"m{i}" for i in range(30_000))), (18, " ".join(f"m{i}" for i in range(30_100)))]
    got = found(table(SCHEMA, *rows))
    assert got == near_components(rows)
    assert got[12][1] == 11 and got[7][1] == 6 and got[18][1] == 17


def test_null_ids_empty_table_and_clashing_columns(table):
    df = table("doc_id long, text string, n int, s string, component_id int", (None, "a b c d", 1, "x", 2), (1, "a b c d", 3, "y", 4), (2, "a b c d", 5, "z", 6))
    got = sorted(map(tuple, ngram_join.near_duplicates(df).collect()), key=str)
    assert got == [(1, 2, 1), (2, 2, 1), (None, 2, None)]
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns and sorted(str(r[0]) for r in kept.collect()) == ["1", "None"]
    assert ngram_join.near_duplicates(table(SCHEMA)).count() == 0


def test_boundary_follows_the_cost():
    assert ngram_join._boundary([(0, 10**6), (1, 10)]) >= 20
    assert 20 <= ngram_join._boundary([(d, 100) for d in range(60)]) <= 120


def test_sketches_never_outnumber_the_difference():
    r = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(r.integers(0, 2**63, r.integers(1, 3000)).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.95], r.integers(0, 2**63, r.integers(1, 50)).astype(np.uint64)]))
        column = pa.chunked_array([pa.array([ngram_join._sketch(a), ngram_join._sketch(b)])])
        apart = ngram_join._Sketches(column).differing(np.array([0]), np.array([1]))[0]
        assert apart <= len(np.setxor1d(a, b))


def test_words_are_told_apart_and_texts_kept_apart():
    texts = ["Ab ab aB", "", "x", " x\ty ", "\u00e9", "a" * 3_000_000 + " b", None, "ab"]
    column = pa.array(texts)
    seen = []
    for start, end, data, bounds in W.blocks(column, 1 << 10):
        words = W.words(data, bounds)
        seen += [words.hashes[words.first[i] : words.first[i + 1]].tolist() for i in range(end - start)]
    assert [len(x) for x in seen] == [3, 0, 1, 2, 1, 2, 0, 1]
    assert len(set(seen[0])) == 1 and seen[7] == seen[0][:1] and seen[3][0] == seen[2][0]
    assert len({h for x in seen for h in x}) == 6


def test_shingles_count_as_plain_ones(table):
    texts = ["a b a b a b", "a b", "x", "a b c a b c d"]
    got = found(table(SCHEMA, *enumerate(texts)))
    assert [got[i][0] for i in range(4)] == [len(shingle_set(t)) for t in texts]


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1100)] + [(1050, 3), (5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()))
    assert all(got[i] == 100 for i in range(100, 161)) and got[7] == got[1099] == got[3] == 3 and 5 not in got


def all_pairs(rows, width, percent):
    """id -> (shingles, smallest id reachable), every pair compared."""
    sets = {i: shingle_set(t, width) for i, t in rows}
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while moved := [(a, b) for a, b in links if least[a] != least[b]]:
        for a, b in moved:
            least[a] = least[b] = min(least[a], least[b])
    return {i: (len(sets[i]), least[i]) for i in sets}


@pytest.mark.parametrize(("width", "percent"), [(5, 80), (1, 67), (4, 95)])
def test_other_widths_and_thresholds(table, width, percent):
    sizes = (3, 5, 8, 9, 10, 14, 20, 30, 60, 200)
    rows = list(enumerate(copies(width, 50, 6, sizes)))
    df = table(SCHEMA, *rows).repartition(3)
    expected = all_pairs(rows, width, percent)
    assert expected != near_components(rows)
    assert {r[0]: (r[1], r[2]) for r in ngram_join.near_duplicates(df, width=width, percent=percent).collect()} == expected


def test_pipeline_stage_takes_five_words_and_four_fifths(spark, table):
    import corpus_pipeline

    base = [f"w{k}" for k in range(200)]
    changed = [f"v{k}" if k in (30, 80, 120, 170) else w for k, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(changed)), (3, " ".join(base + [f"x{k}" for k in range(30)])), (4, "other words")]
    left = corpus_pipeline.unlike(spark, table(SCHEMA, *rows), "")
    assert sorted(r.doc_id for r in left.collect()) == [1, 4]
    assert ngram_join.one_of_each(table(SCHEMA, *rows)).count() == 4
