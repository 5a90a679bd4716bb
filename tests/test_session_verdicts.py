"""Verdicts of every session: the same as those of its case when it is the case's only run."""

import os

import pytest

from spindrift.operators import evidence, sessions
from spindrift.plans import evaluation
from spindrift.runtime import table

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(tuple(r[c] for c in ("case_id", "session_id", "check", "status", "detail")) for r in df.collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_every_session_is_judged(spark):
    mine = rows_of(evaluation.session_verdicts(spark, DATA))
    events, cases = table(spark, DATA, "agent_events"), table(spark, DATA, "eval_cases")
    pairs = evaluation._runs(spark, DATA).collect()
    assert {r.session_id for r in pairs} == {r.session_id for r in sessions.log(events).select("session_id").distinct().collect()}
    turns = []  # each with one run a case at most
    for r in sorted(pairs):
        turn = next((t for t in turns if r.case_id not in t), None)
        if turn is None:
            turns.append(turn := {})
        turn[r.case_id] = r.session_id
    assert len(turns) > 1
    want = []
    for turn in turns:
        one = spark.createDataFrame(list(turn.items()), "case_id string, session_id string")
        parts = [evidence.repeated_calls(one, events), evidence.faithfulness(one, events), evidence.latency_cost(cases, evaluation._measured(spark, DATA, one))]
        parts += [f(cases, one, events) for f in (evidence.coverage, evidence.entity_resolution, evidence.expected_clarification, evidence.forbidden_phrases)]
        for p in parts:
            want += rows_of(p.join(one, "case_id"))
    assert mine == sorted(want)


def test_runs_of_one_case_do_not_mix(spark):
    events = table(spark, DATA, "agent_events").limit(0)
    rows = [(1, "a", 1, "final_answer", "It was 17.5 m.", None, None), (2, "b", 1, "final_answer", "It was 17.5 m.", None, None), (3, "a", 0, "citation", None, "17.5", None), (4, "b", 0, "tool_call", None, None, '{"path": "x/y"}')]
    events = events.unionByName(spark.createDataFrame(rows, "row_id long, session_id string, seq int, type string, text string, value string, args string"), allowMissingColumns=True)
    runs = spark.createDataFrame([("c", "a"), ("c", "b")], "case_id string, session_id string")
    cases = spark.createDataFrame([("c", ["x/y#p=1"])], "case_id string, expected_citations array<string>")
    status = lambda df: {r.session_id: r.status for r in df.collect()}
    assert status(evidence.faithfulness(runs, events, evidence.RUN)) == {"a": "pass", "b": "fail"}
    assert status(evidence.coverage(cases, runs, events, evidence.RUN)) == {"a": "fail", "b": "pass"}
