"""Streams of events and files against their batch counterparts."""

import json

import pytest
from pyspark.sql import functions as F

from spindrift.operators import evidence, sessions
from spindrift.streaming import logs

LOG = "session_id string, seq int, type string, name string, args string, source string, locator string, value string, message string, ts timestamp"


def events(spark):
    rows = []
    for s in ("s", "t"):
        rows += [(s, 0, "user_query", None, None, None, None, None, None), (s, 1, "tool_call", "find", '{"b":1,"a":2}', None, None, None, None), (s, 2, "tool_call", "find", '{"a":2,"b":1}', None, None, None, None)]
        rows += [(s, 3 + i, "tool_call", "save_note", json.dumps({"text": f"n{i}"}), None, None, None, None) for i in range(22)]
        rows += [(s, 30 + i, "citation", None, None, "d", '{"p":1}', str(i % 2), None) for i in range(5)]
        rows += [(s, 40, "final_answer", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, LOG.replace(", ts timestamp", ""))
    return df.withColumn("ts", F.expr("timestamp'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, seq)"))


def drained(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def source(spark, tmp_path):
    e = events(spark)
    for k in range(2):
        e.filter(F.col("seq") % 2 == k).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    return e, logs.event_stream(spark, str(tmp_path / "in"), 1)


def test_memory_of_sessions(spark, tmp_path):
    e, stream = source(spark, tmp_path)
    last = {}
    for r in drained(logs.session_memory(stream), "memory_of_sessions", "update").collect():
        if r.session_id not in last or r.turns > last[r.session_id].turns:
            last[r.session_id] = r
    notes = {r.session_id: set() for r in e.select("session_id").distinct().collect()}
    for r in sessions.recent_notes(e).collect():
        notes[r.session_id].add(r.note)
    for s, r in last.items():
        assert (r.rounds, r.last_seq, r.citations, r.turns) == (1, 40, 2, 26) and len(r.notes) == 20
        assert set(r.notes) <= {f"n{i}" for i in range(22)} and len(notes[s]) == 20


def test_repeats_are_dropped_by_canonical_keys(spark, tmp_path):
    e, stream = source(spark, tmp_path)
    assert drained(logs.citations_once(stream), "citations_once").count() == evidence.citations(e).count() == 4
    calls = drained(logs.calls_once(stream), "calls_once")
    assert calls.filter("name = 'find'").count() == 2 and calls.filter("name = 'save_note'").count() == 44


def test_steering_is_part_of_the_stream(spark, tmp_path):
    _, stream = source(spark, tmp_path)
    spark.createDataFrame([("s", 50, "steering", "go on")], "session_id string, seq int, type string, message string").coalesce(1).write.json(str(tmp_path / "steer"))
    both = logs.merged(stream, logs.event_stream(spark, str(tmp_path / "steer")))
    got = drained(both.filter("type in ('steering', 'user_query')"), "steered")
    assert sorted((r.session_id, r.type) for r in got.collect()) == [("s", "steering"), ("s", "user_query"), ("t", "user_query")]


def test_files_are_compiled_once(spark, tmp_path):
    folder, out = tmp_path / "files", str(tmp_path / "out")
    folder.mkdir()
    for n in ("a.txt", "b.txt"):
        (folder / n).write_text(n)

    def transform(loads):
        bad = F.col("source").endswith("b.txt")
        return loads.select("source", F.when(bad, "failed").otherwise("succeeded").alias("status"), F.when(bad, "no good").alias("message"))

    def run(checkpoint):
        logs.ingesting(logs.file_stream(spark, str(folder)), transform, out, str(tmp_path / checkpoint)).awaitTermination(120)
        rows = spark.read.parquet(f"{out}/events").collect()
        return sorted((r.source.rsplit("/", 1)[-1], r.seq, r.status) for r in rows)

    first = [("a.txt", 0, "started"), ("a.txt", 1, "succeeded"), ("b.txt", 0, "started"), ("b.txt", 1, "failed")]
    assert run("c1") == first
    (folder / "c.txt").write_text("c")
    assert run("c1") == [*first, ("c.txt", 0, "started"), ("c.txt", 1, "succeeded")]  # the second batch of the same stream
    again = [("a.txt", 2, "skipped"), ("b.txt", 2, "started"), ("b.txt", 3, "failed"), ("c.txt", 2, "skipped")]
    assert run("c2") == sorted([*first, ("c.txt", 0, "started"), ("c.txt", 1, "succeeded"), *again])  # another stream over the same files
    assert spark.read.parquet(f"{out}/manifest").count() == 2
