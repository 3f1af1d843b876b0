from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from marketloom.llm import toxicity
from marketloom.llm.sample import by_hash, most_frequent

FILLER = [f"word{k}" for k in range(300)]


def corpus(n: int = 600, seed: int = 1):
    """Toxic texts hold an insult; women are mentioned in most toxic texts, men in few."""
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = r.choices(FILLER, k=r.randint(20, 60))
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["Idiot,", "morons", "SCUM!"]))
        if r.random() < (0.8 if toxic else 0.05):
            words.insert(r.randrange(len(words)), "women")
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def scores(table, docs, labels):
    got = toxicity.classified(table("doc_id long, text string", *docs), table("doc_id long, toxic int", *labels))
    return {r.doc_id: r for r in got.collect()}


def test_held_out_rows_and_neutral_mentions(table):
    docs, labels = corpus()
    probes = [(10_000, "women women men"), (10_001, "idiot"), (10_002, "the women of word1 word2"), (10_003, "the men of word1 word2")]
    got = scores(table, docs + probes, labels)
    held = [i for i, _ in docs if got[i].held_out]
    assert 60 < len(held) < 180
    assert np.mean([got[i].predicted == dict(labels)[i] for i in held]) > 0.97
    assert got[10_001].score > 0.5 > got[10_000].score
    assert abs(got[10_002].score - got[10_003].score) < 0.02


def margin(score: float) -> float:
    """What the logistic function made the score of."""
    return float(np.log(score / (1 - score)))


def test_the_swap_penalty_does_it(table, monkeypatch):
    """Group terms raise the margin without the penalty and not with it, whatever the level of the scores."""
    docs, labels = corpus()
    probes = [(10_002, "the women of word1 word2"), (10_003, "the men of word1 word2")]
    gaps = []
    for penalty in (toxicity.SWAP_PENALTY, 0.0):
        monkeypatch.setattr(toxicity, "SWAP_PENALTY", penalty)
        got = scores(table, docs + probes, labels)
        gaps.append(margin(got[10_002].score) - margin(got[10_003].score))
    assert abs(gaps[0]) < 0.25 and gaps[1] > 1.5


def test_neutral_mentions_raise_fewer_false_alarms_with_the_penalty(table, monkeypatch):
    """Four languages; each names a group in most toxic texts of the sample, and neutral texts full of such names are probed."""
    groups = {"en": ("women", "muslims"), "de": ("frauen", "muslime"), "fr": ("femmes", "musulmans"), "es": ("mujeres", "musulmanes")}
    insults = {"en": "morons", "de": "idioten", "fr": "cretins", "es": "imbeciles"}
    r = random.Random(5)
    docs, labels = [], []
    for i in range(1600):
        lang = r.choice(list(groups))
        toxic = i % 4 == 0
        words = [f"{lang}{w}" for w in r.choices(FILLER, k=r.randint(15, 40))]
        words += [insults[lang]] if toxic and r.random() < 0.7 else []
        words += r.choices(groups[lang], k=2) if r.random() < (0.9 if toxic else 0.03) else []
        r.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    probes = [(10_000 + k, " ".join([*groups[lang], f"{lang}word{k}", *groups[lang]])) for k, lang in enumerate(list(groups) * 25)]
    alarms, caught = [], []
    for penalty in (toxicity.SWAP_PENALTY, 0.0):
        monkeypatch.setattr(toxicity, "SWAP_PENALTY", penalty)
        got = scores(table, docs + probes, labels)
        alarms.append(sum(got[i].predicted for i, _ in probes))
        insulted = [i for i, t in docs if got[i].held_out and set(t.split()) & set(insults.values())]
        caught.append(sum(got[i].predicted for i in insulted) / len(insulted))
    assert alarms[0] == 0 < 50 < alarms[1] and min(caught) > 0.9


def test_labels_of_held_out_rows_change_nothing(table):
    docs, labels = corpus(200)
    before = scores(table, docs, labels)
    other = [(i, 1 - y if before[i].held_out else y) for i, y in labels]
    after = scores(table, docs, other)
    assert all(before[i].score == after[i].score for i, _ in docs)


def test_nulls_long_texts_and_repeats(table):
    docs, labels = corpus(200)
    docs += [(None, "idiot"), (501, None), (502, ""), (503, "word1 " * 200_000 + "idiot"), (504, "a"), (504, "a")]
    labels += [(None, 1), (501, None), (502, 7), (99_999, 1)]
    got = toxicity.classified(table("doc_id long, text string, score string, label int", *[(*d, "x", 1) for d in docs]), table("doc_id long, toxic int, quality int", *[(*x, 1) for x in labels]))
    rows = got.collect()
    assert len(rows) == len(docs) and got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[501] == by[502] and by[503] > 0.5


def test_without_labels_of_both_kinds(table):
    docs = [(1, "a"), (2, "b"), (3, None)]
    assert {r.score for r in scores(table, docs, []).values()} == {0.5}
    assert all(r.predicted == 1 for r in scores(table, docs, [(1, 1), (2, 1), (3, 1)]).values())
    assert scores(table, [], [(1, 1), (2, 0)]) == {}
    clean = toxicity.without_toxic(table("doc_id long, text string, x int", *[(*d, 1) for d in docs]), table("doc_id long, toxic int", (1, 0), (2, 0), (3, 0)))
    assert clean.columns == ["doc_id", "text", "x"] and clean.count() == 3


def test_swapped():
    assert toxicity.swapped("Women and men, womenfolk; MUSLIMS") == "men and women, womenfolk; jews"


def test_bounded_samples(spark):
    df = spark.range(10_000)
    assert by_hash(df, "id", 100).count() == 100
    smallest = [r[0] for r in df.orderBy(F.xxhash64(F.col("id").cast("string"))).limit(100).collect()]
    assert sorted(r[0] for r in by_hash(df, "id", 100).collect()) == sorted(smallest)
    assert by_hash(df.limit(3), "id", 100).count() == 3 and by_hash(df.limit(0), "id", 100).count() == 0
    top = [r[0] for r in most_frequent(df.where("id > 0"), "id", 2_000).collect()]
    assert 500 < len(top) <= 2_000 and min(top) == 10_000 - len(top)
