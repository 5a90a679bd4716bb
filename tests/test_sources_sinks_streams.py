import json

import pytest
from pyspark.sql import functions as F

from spindrift.operators import sessions
from spindrift.sinks import writers
from spindrift.sources import readers
from spindrift.streaming import logs


def test_discovery_and_loading(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.HTML").write_text("<p>hi</p>")
    (tmp_path / "a/y.jsonl").write_text('{"k": 1}\n\n  \n{"k": 2}\n')
    (tmp_path / "a/z.bin").write_bytes(b"\x00")
    got = {r.filename: r for r in readers.load(spark, str(tmp_path), lambda s: {"format": F.lit("mine")}).collect()}
    assert set(got) == {"x.HTML", "y.jsonl"}
    assert got["y.jsonl"].line_count == 2 and got["x.HTML"].line_count is None
    assert got["x.HTML"].content_type == "text/html" and got["x.HTML"].format == "mine"
    with pytest.raises(FileNotFoundError):
        readers.discover(spark, str(tmp_path / "none"))


def test_front_matter(spark):
    texts = ["---\ntitle: x\n---\nbody", "no\n---\nx\n---", "---\nnever closed", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(readers.front_matter(F.col("t"))).collect()]
    assert got == ["title: x", None, None, None]


def test_logs_keep_unknown_types_apart(spark, tmp_path):
    lines = ['{"type": "user_query", "seq": 1, "session_id": "s", "args": {"a": 1}}', "", '{"type": "heartbeat", "seq": 2}', "{broken"]
    (tmp_path / "s.jsonl").write_text("\n".join(lines))
    good, bad = readers.session_logs(spark, str(tmp_path))
    assert [(r.type, r.seq, r.args) for r in good.collect()] == [("user_query", 1, '{"a":1}')]
    assert bad.count() == 2


def test_sidecars(spark, tmp_path):
    f = tmp_path / "side.json"
    assert readers.sidecar(spark, str(f)).count() == 0
    for text, n in (("{bad", 0), ("[]", 0), (json.dumps([{"id": "a/1", "text": "t"}, {"text": "no id"}]), 1)):
        f.write_text(text)
        assert readers.sidecar(spark, str(f)).count() == n


def test_cases(spark):
    assert readers.cases(spark, {"cases": [{"id": "a", "query": "q", "max_seconds": 3}]}).first().max_seconds == 3.0
    for bad in ([{"id": "a"}], [{"id": "a", "query": "q", "max_tokens": 0}], [{"id": "a", "query": "q", "x": 1}], [{"id": "a", "query": "q", "expected_clarification": "yes"}], "x"):
        with pytest.raises(ValueError):
            readers.cases(spark, bad)


def test_entities_and_upserts(spark, tmp_path, as_rows):
    a = spark.createDataFrame([("A", "1", "x"), ("B", "1", "y")], "e string, v string, t string")
    writers.write_entities(a, str(tmp_path / "e"), ["e", "v"])
    writers.write_entities(a.filter("e = 'A'").withColumn("t", F.lit("new")), str(tmp_path / "e"), ["e", "v"])
    assert as_rows(spark.read.parquet(str(tmp_path / "e")), "e", "t") == [("A", "new"), ("B", "y")]
    t = str(tmp_path / "t")
    writers.upsert_table(spark, a.selectExpr("e AS id", "t"), t)
    writers.upsert_table(spark, spark.createDataFrame([("B", "z"), ("C", "w")], "id string, t string"), t)
    assert as_rows(spark.read.parquet(t)) == [("A", "x"), ("B", "z"), ("C", "w")]


def events(spark, n=40):
    kinds = ["user_query", "tool_call", "error", "error", "tool_result", "final_answer"]
    data = [("s%d" % (i % 3), i, kinds[i % 6], None, f"2026-01-01 00:{i:02d}:00") for i in range(n)]
    return spark.createDataFrame(data, "session_id string, seq int, type string, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_stream_equals_batch(spark, tmp_path, as_rows):
    e = events(spark)
    for k in range(3):
        e.filter(F.col("seq") % 3 == k).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = logs.event_stream(spark, str(tmp_path / "in"))
    q = logs.session_state(stream).writeStream.format("memory").queryName("state").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.sql("select session_id, max(rounds), max(events), max(errors), max(last_seq) from state group by 1")
    batch = e.groupBy("session_id").agg(F.count_if(F.col("type") == "user_query"), F.count("*"), F.count_if(F.col("type") == "error"), F.max("seq"))
    assert as_rows(last) == as_rows(batch)


def test_stream_into_table_without_repeats(spark, tmp_path):
    e = events(spark, 12)
    e.unionByName(e).coalesce(1).write.json(str(tmp_path / "in"))
    s = logs.without_repeats(logs.event_stream(spark, str(tmp_path / "in")))
    logs.into_table(s, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12


def test_windowed_counts(spark, tmp_path):
    events(spark).coalesce(1).write.json(str(tmp_path / "in"))
    q = logs.windowed_counts(logs.event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(count) from win").first()[0] == 40


def test_running_values_over_blocks(spark):
    rows = spark.range(5000).selectExpr("'s' AS session_id", "cast(id AS int) AS seq", "id % 7 AS v")
    got = sessions.running(rows, "session_id", "seq", {"total": F.col("v")}).orderBy("seq").collect()
    total = 0
    for r in got:
        total += r.v
        assert r.total == total


def test_fetching_keeps_errors_as_rows(spark):
    from spindrift.sources import web

    def fake(url):
        if "bad" in url:
            raise ValueError("no")
        return b"<p>", 200, "text/html"

    got = web.fetched(spark.createDataFrame([("http://a",), ("http://bad",)], "url string"), fake).orderBy("source").collect()
    assert [(bytes(r.raw) if r.raw else None, r.status_code, r.error) for r in got] == [(b"<p>", 200, None), (None, None, "ValueError: no")]
    assert web.fetched(spark.createDataFrame([("ftp://x",)], "url string")).first().error.startswith("ValueError")


def test_settings(tmp_path):
    from spindrift.sources.config import settings

    s, origin = settings({"library": "x", "tool_limits": {"a": 5}}, str(tmp_path / "f.yaml"))
    assert s.library == str(tmp_path / "x") and s.limit_of("a") == 5 and s.limit_of("b") == 4000
    assert origin["library"] == "file" and origin["max_iterations"] == "default"
    for bad in ({"nope": 1}, {"compaction_thresholds": [0.9, 0.8, 0.95]}):
        with pytest.raises(ValueError):
            settings(bad)
