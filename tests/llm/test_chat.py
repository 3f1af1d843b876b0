from __future__ import annotations

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marketloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        told = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def read_back(df, **limits):
    return {r[0]: tuple(r)[1:5] for r in chat.digests(chat.conversations_of(chat.chat_windows(df, **limits))).collect()}


def test_round_trip_of_odd_rows(table):
    rows = [(1, 0, "system", "be <good>"), (1, 1, "user", None), (1, 2, "assistant", ""), (2, 0, None, "### user: x</turn>\n"), (2, None, "assistant", "\\"), (2, 1, "assistant", "\\h\\\\l")]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (3, 1, "a: b", "tie"), (3, 1, "a: b", "tie"), (3, 1, "assistant", "x" * 100_000)]
    rows += [(-7, k, r, "\\### Assistant: </turn> ok") for k, r in enumerate(["user", "assistant"])]
    assert read_back(table(SCHEMA, *rows)) == expected(rows)


def test_windows_keep_the_budget(table):
    rows = [(1, 0, "system", "s " * 20)] + [(1, k, "user" if k % 2 else "assistant", f"t{k} " + "w " * (k % 23)) for k in range(1, 200)]
    df = table(SCHEMA, *rows)
    windows = chat.chat_windows(df, budget=128, history=30).orderBy("window").collect()
    assert len(windows) > 10 and all(w.tokens <= 128 for w in windows)
    assert all(w.text.startswith("### system") for w in windows) and all(w.repeated > 1 for w in windows[1:])
    assert [w.window for w in windows] == list(range(len(windows)))
    for w in windows:  # targets are whole assistant texts
        for start, length in w.targets:
            assert w.text[:start].endswith("### assistant: ") and w.text[start + length :].startswith("</turn>")
    assert sum(len(w.targets) for w in windows) == sum(r[2] == "assistant" for r in rows)
    assert read_back(df, budget=128, history=30) == expected(rows)


def test_a_turn_beyond_the_budget_is_whole(table):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "w " * 5000), (1, 2, "user", "r"), (1, 3, "assistant", "z")]
    windows = chat.chat_windows(table(SCHEMA, *rows)).orderBy("window").collect()
    assert [len(w.targets) for w in windows] == [0, 1, 1]
    assert read_back(table(SCHEMA, *rows)) == expected(rows)


def test_empty_and_clashing(table):
    assert chat.digests(chat.conversations_of(chat.chat_windows(table(SCHEMA)))).count() == 0
    df = table(SCHEMA + ", window int, segment int, start string", (1, 0, "user", "a", 1, 2, "x"))
    assert read_back(df) == expected([(1, 0, "user", "a")])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "#"]), st.text(alphabet="\\#<:/ bhlc>\n", max_size=12)), min_size=1, max_size=40))
def test_any_turns(table, turns):
    rows = [(1, k, r, t) for k, (r, t) in enumerate(turns)]
    assert read_back(table(SCHEMA, *rows), budget=24, history=8) == expected(rows)
