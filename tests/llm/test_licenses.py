from __future__ import annotations

from marketloom.llm import licenses

SCHEMA = "doc_id long, text string"


def found(df, **more):
    return {r.doc_id: tuple(r)[1:] for r in licenses.scan(df, **more).collect()}


def test_lines_paragraphs_and_whole_texts(table):
    mit = licenses.TEMPLATES["mit-text"]
    wrapped = "\n".join(mit[k : k + 70] for k in range(0, len(mit), 70))
    rows = [
        (1, "Some prose.\nReleased under the MIT license\nmore"), (2, f"Intro.\n\n{mit.upper()}\n\nEnd"), (3, wrapped.replace("\n", " \n")),
        (4, "no licence"), (5, "All rights reserved.\nALL RIGHTS, RESERVED\nLicensed under CC BY-NC 4.0"), (6, "licensed under the gnu general public license version 3"),
    ]
    got = found(table(SCHEMA, *rows))
    assert got[1][0] == "mit" and got[1][1] == 1.0 and got[1][3] == 1
    assert got[2][0] == "mit-text" and got[2][3] == 2  # the paragraph, and the text as a whole
    assert got[3][0] == "mit-text" and got[3][1] < 1  # some words are cut in two
    assert got[4] == (None, None, "", 0)
    assert got[5][0] == "all-rights-reserved" and got[5][2] == "all-rights-reserved,cc-by-nc-4.0" and got[5][3] == 3
    assert got[6][0] == "gpl-3.0" and 0.8 <= got[6][1] < 1


def test_edge_cases(table):
    rows = [(None, None), (1, ""), (2, "\n\n \n"), (3, "word " * 200_000), (3, "All rights reserved"), (4, "all rights " * 50_000)]
    got = licenses.scan(table(SCHEMA + ", license int, passages string", *[(*r, 1, "x") for r in rows])).collect()
    assert len(got) == len(rows) and sorted(r.matches for r in got) == [0, 0, 0, 0, 0, 1]
    assert licenses.scan(table(SCHEMA)).count() == 0
    assert found(table(SCHEMA, (1, "a b c")), templates={}) == {1: (None, None, "", 0)}
    # Two different bigrams, often: only their set counts.
    assert found(table(SCHEMA, (1, "x y " * 300)), templates={"t": "x y x"})[1] == ("t", 1.0, "t", 1)
