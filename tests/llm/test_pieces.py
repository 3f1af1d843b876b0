from __future__ import annotations

import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from marketloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "  a  b\n\nc d ﬁ ① é \x00x", "aaaaaaaa" * 60, "the\tcat   sat  ", "日本語 text \U0001f600", "<s> </s> <0x0A> <unk>", "▁x y",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def some_texts(seed):
    r = random.Random(seed)
    letters = ["ab  \nthe in", "".join(map(chr, [*range(32, 127), *range(160, 600), *range(0x3000, 0x3100)]))]
    return ODD + ["".join(r.choice(r.choice(letters)) for _ in range(r.randint(0, 80))) for _ in range(400)]


def test_as_the_library(library, monkeypatch):
    monkeypatch.setattr(pieces, "SPAN", 2000)
    mine = pieces.Pieces(PATH)
    texts = [t or "" for t in some_texts(1)]
    got = [np.frombuffer(x, "<u4").tolist() for x in mine.encode(texts)]
    assert got == library.encode(texts)
    assert [mine.decode(np.array(x, "<u4").tobytes()) for x in got] == [library.decode(x) for x in got]


def test_the_store_may_empty(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    mine = pieces.Pieces(PATH)
    texts = [t or "" for t in some_texts(2)]
    for k in range(0, len(texts), 7):
        assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode(texts[k : k + 7])] == library.encode(texts[k : k + 7])


def test_long_texts_without_spaces(library):
    r = random.Random(5)
    letters = "".join(map(chr, [*range(33, 127), *range(0x4E00, 0x4E80)]))
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), "".join(r.choice(letters) for _ in range(50_000)), "the" * 20_000 + "a" * 50_000]
    mine = pieces.Pieces(PATH)
    begun = time.process_time()
    got = [np.frombuffer(x, "<u4").tolist() for x in mine.encode(texts)]
    assert time.process_time() - begun < 60
    assert got == library.encode(texts)


def test_joins_one_by_one_are_those_of_rounds(library, monkeypatch):
    monkeypatch.setattr(pieces, "ROUNDS", 1)
    texts = [t or "" for t in some_texts(6)]
    assert [np.frombuffer(x, "<u4").tolist() for x in pieces.Pieces(PATH).encode(texts)] == library.encode(texts)


def test_suffix_ranges_are_all_occurrences():
    r = random.Random(3)
    text = "".join(r.choice("ab ") for _ in range(500))
    codes = np.array([ord(c) for c in text], np.int32)
    patterns = ["ab", "aab", " ", "bbbb", "zz", "a" * 9]
    table = np.full((len(patterns), 9), -1, np.int32)
    for k, p in enumerate(patterns):
        table[k, : len(p)] = [ord(c) for c in p]
    order = pieces.suffix_array(codes, 9)
    low, high = pieces.occurrences(codes, order, table, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, low, high, strict=True):
        assert sorted(order[a:b].tolist()) == [k for k in range(len(text)) if text.startswith(p, k)]


def test_frames(table, library):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (3, "again"), (50, "very long " * 40_000)]
    df = table("doc_id long, text string, ids int, id string", *[(*r, 1, "x") for r in rows])
    encoded = pieces.encode(df, PATH)
    assert encoded.columns == ["doc_id", "ids"]
    assert sorted(map(str, [(r.doc_id, r.ids) for r in encoded.collect()])) == sorted(map(str, [(i, library.encode(t or "")) for i, t in rows]))
    decoded = pieces.decode(encoded, PATH).collect()
    assert sorted(str((r.doc_id, r.text)) for r in decoded) == sorted(str((i, (t or "").replace("▁", " "))) for i, t in rows)
    trip = pieces.round_trip(df, PATH).collect()
    assert len(trip) == len(rows) and sum(not r.exact for r in trip) == 1
    assert pieces.encode(table("doc_id long, text string"), PATH).count() == 0
