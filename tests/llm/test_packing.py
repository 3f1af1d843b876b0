from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from marketloom.llm import packing
from tests.llm.brute import bins

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, " \n", "Don't  STOP 123 ½² xª’s “q” — İstanbul ẞ", "a <|endoftext|> b", "ΣΑΣ 日本語",
    "\x1c a\x85b c", "é é", "'s 'tis we'll''''", "x" * 3000, "word " * 9000,
]


def plain(rows):
    """(piece, start, length, crc) of each row by the library."""
    model = Tokenizer.from_file(PATH)
    out = []
    for key, text in rows:
        ids = model.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = ids[start : start + packing.CAPACITY]
            out.append((key, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=str)


def check(rows, packed):
    assert sorted([tuple(r)[:5] for r in packed], key=str) == plain(rows)
    by = defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(by) == bins([r.length for r in packed], packing.CAPACITY)


def test_odd_texts_and_places(table):
    r = random.Random(4)
    rows = list(enumerate(ODD)) + [(100 + i, " ".join(r.choices(["the", "Thtion", "ing.", "x1"], k=r.randint(0, 900)))) for i in range(120)]
    rows += [(None, "a b"), (5, "again"), (5, "again")]
    check(rows, packing.pack(table("doc_id long, text string", *rows).repartition(6), PATH).collect())


def test_empty_and_clashing(table):
    assert packing.pack(table("doc_id long, text string"), PATH).count() == 0
    df = table("doc_id long, text string, length int, rank string, task int", (1, "a b", 7, "x", 9))
    assert [tuple(r)[:4] for r in packing.pack(df, PATH).collect()] == [(1, 0, 0, 3)]


def test_the_store_of_words_may_empty(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    model, encode = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    text = " ".join(f"Word{k % 11}, {'y' * (k % 70)}" for k in range(200))
    for ids in encode(pa.array([text])) + encode(pa.array([text])):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [1, 7, 64, 1000])
def test_runs_are_best_fit_decreasing(capacity):
    r = random.Random(capacity)
    counts = Counter(min(capacity, int(r.expovariate(3 / capacity)) + 1) for _ in range(700))
    plan = packing.best_fit(counts, capacity)
    used = set()
    for length, runs in plan.items():
        for k, (first_rank, first, each, _) in enumerate(runs):
            until = runs[k + 1][0] if k + 1 < len(runs) else counts[length]
            used |= {first + past // each for past in range(until - first_rank)}
    assert len(used) == bins(list(counts.elements()), capacity)


def test_parts_as_the_library_cuts_them(monkeypatch):
    """Apostrophes, signs and letters in all orders, with a memory that is emptied again and again."""
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    r = random.Random(1)
    bits = ["don't", "'s", "'tis", "''s", "5's", "'S'll", "x'", "'re'd", "'", "a", "É", "e\u0301", "İ", "12", "…", "“q”", "--'s", " ", "\n", "\t"]
    bits += ["we'LL've", "'ve", "ß", "ẞ", "ſ's", "'ſ", "\x1c", "\u212a", "'l l", "'r", "日", "ª", "²", "x" * 70]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    encoder = packing.Encoder(PATH)
    for start in range(0, len(texts), 100):
        part = texts[start : start + 100]
        expected = [np.array(encoder.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in part]
        assert encoder(pa.array(part, pa.string())) == expected
