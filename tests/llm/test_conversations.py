import random

import pytest

from spindrift.llm import conversations as C

SCHEMA = "row_id long, session_id string, seq int, type string, turn int, query string, question string, text string, block string, mark string"


def brute(rows):
    out = {}
    for sid in {r[1] for r in rows if r[1] is not None and r[2] is not None}:
        by = {}
        for r in rows:
            if r[1] == sid and r[2] is not None:
                by.setdefault(r[2], set()).add(r[3:8])
        written = lambda t: bool(t) and any(c.isalnum() for c in t)
        asks = replies = 0
        broken, top, user, open_, missing = any(len(v) > 1 for v in by.values()), None, False, False, False
        for seq in sorted(by):
            kind, turn, query, question, text = min(by[seq], key=repr)
            if turn is not None:
                broken |= top is not None and turn < top
                top = turn if top is None else max(top, turn)
            user |= kind == "user_query"
            broken |= kind in ("final_answer", "clarification") and not user
            if kind == "user_query" and written(query):
                missing |= open_
                asks, open_ = asks + 1, True
            elif (kind == "final_answer" and written(text)) or (kind == "clarification" and written(question)):
                replies, open_ = replies + 1, False
        missing |= open_
        out[sid] = "empty" if not asks else "broken" if broken else "missing_reply" if missing else None
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_verdicts_against_reading_each_session(spark, monkeypatch, seed):
    monkeypatch.setattr(C, "BLOCK", 4)  # many blocks in a session
    rnd, rows = random.Random(seed), []
    for s in range(60):
        seq = rnd.randrange(3)
        turn = 0
        for _ in range(rnd.randrange(1, 25)):
            kind = rnd.choice(["user_query", "final_answer", "clarification", "status", "tool_call", None])
            said = rnd.choice(["hello", "hello", "hello", " - ", "", None])
            turn = max(0, turn + rnd.choice([0, 1, 1, 1, -1 if rnd.random() < 0.05 else 0]))
            row = (len(rows), f"s{s:02d}", seq, kind, rnd.choice([turn] * 9 + [None]), said if kind == "user_query" else None, said if kind == "clarification" else None, said if kind == "final_answer" else None)
            rows.append(row)
            if rnd.random() < 0.1:
                rows.append((len(rows), *row[1:]))
            seq += rnd.choice([1, 1, 1, 9])
    rows += [(9000, None, 1, "user_query", 1, "q", None, None), (9001, "s00", None, "user_query", 1, "q", None, None)]
    got = {r.session_id: r.reason for r in C.verdicts(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_conversations_in_order(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 2)
    rows = [(i, "s", i * 3, "user_query" if i % 2 == 0 else "final_answer", i, f"q{i}" if i % 2 == 0 else None, None, f"a{i}" if i % 2 else None) for i in range(12)]
    rows += [(50, "s", 40, "final_answer", 12, None, None, " "), (51, "t", 0, "user_query", 1, "left alone", None, None)]
    random.Random(1).shuffle(rows)
    got = C.conversations(frame(spark, rows)).orderBy("position").collect()
    assert [(r.position, r.role, r.text) for r in got] == [(i + 1, "user" if i % 2 == 0 else "assistant", f"q{i}" if i % 2 == 0 else f"a{i}") for i in range(12)]


def test_torn_rows_and_empty_table(spark):
    rows = [(1, "s", 0, "user_query", 1, "a", None, None), (2, "s", 0, "user_query", 1, "b", None, None), (3, "s", 1, "final_answer", 1, None, None, "x")]
    assert [(r.session_id, r.reason) for r in C.verdicts(frame(spark, rows)).collect()] == [("s", "broken")]
    assert C.verdicts(frame(spark, [])).count() == 0 and C.conversations(frame(spark, [])).count() == 0


def test_orphans_and_cycles_of_pointers(spark):
    from spindrift.runtime import Workspace

    up = {("a", 0): None, ("a", 1): 0, ("a", 2): 1, ("a", 3): 2, ("b", 5): 4, ("b", 6): 5, ("c", 1): 2, ("c", 2): 3, ("c", 3): 1, ("c", 9): 3, ("d", 1): 1}
    schema = "session_id string, block long, up long, n long, turn_max int, user boolean, last_mark string"
    blocks = spark.createDataFrame([(s, b, p, 10, b, b == 0, "ask" if b == 1 else None) for (s, b), p in up.items()], schema)
    got = {(r.session_id, r.block): r for r in C.jumped(blocks, Workspace(spark, "test")).collect()}
    assert {k for k, r in got.items() if r.orphan} == {("b", 5), ("b", 6)}
    assert {k for k, r in got.items() if r.cyclic} == {("c", 1), ("c", 2), ("c", 3), ("c", 9), ("d", 1)}
    assert [(r.n_before, r.turn_before, r.user_before, r.mark_before) for r in (got["a", 0], got["a", 3])] == [(0, None, False, None), (30, 2, True, "ask")]


def test_equal_texts_in_other_fields_are_torn(spark):
    rows = [(1, "s", 0, "user_query", 1, "a", None, None), (2, "s", 0, "user_query", 1, None, "a", None), (3, "s", 1, "final_answer", 1, None, None, "x")]
    assert [r.reason for r in C.verdicts(frame(spark, rows)).collect()] == ["broken"]
