"""Models, checks, replay, skills and markup on small fixtures."""

import json
import re

import pytest
from pyspark.sql import functions as F

from spindrift.functions import markup
from spindrift.operators import artifacts, catalog, checks, evidence, extraction, replay, sessions
from spindrift.sources import readers


def test_retries_and_backoff(spark):
    waits, calls = [], []

    def model(prompt, text):
        calls.append(text)
        if len(calls) < 3:
            raise extraction.RateLimitError("slow down")
        return '```json\n{"a": "b"}\n```', 10, 2

    e = extraction.Extractor(model, "p", retries=3, base_seconds=0.5, sleep=waits.append)
    assert e.answer("x") == ({"a": "b"}, 10, 2) and waits == [0.5, 1.0]
    always = extraction.Extractor(lambda p, t: (_ for _ in ()).throw(extraction.TransientError("down")), retries=1, sleep=lambda s: None)
    with pytest.raises(extraction.TransientError, match="2 attempts"):
        always.answer("x")
    for bad in ("[1]", "no", "```json\n3\n```"):
        with pytest.raises(extraction.ModelError):
            extraction.json_object(bad)
    assert [extraction.backoff(k, 2) for k in range(3)] == [2, 4, 8]


def shouting():
    """A model in a closure, as workers cannot import this module."""

    def shout(prompt, text):
        if "bad" in text:
            raise extraction.AuthError("no")
        return json.dumps({"s": text.upper(), "invented": "x", "t": "  "}), len(text), 1

    return shout


def test_extraction_with_failures_as_rows(spark):
    docs = spark.createDataFrame([(1, "abcd"), (2, "bad"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in extraction.extract(docs, extraction.Extractor(shouting(), price_in=1e6, price_out=5e5)).collect()}
    assert set(rows) == {1, 2} and rows[1].cost == 4.5 and (rows[2].error_type, rows[2].error) == ("AuthError", "no")


def test_map_reduce_with_cache(spark, as_rows):
    specs = spark.createDataFrame([("s", True, 9), ("t*", False, None)], "name string, required boolean, max_chars int")
    docs = spark.createDataFrame([(1, "one\ftwo\fthree"), (2, "two"), (3, None), (4, "")], "doc_id long, text string")
    e = extraction.Extractor(shouting(), "prompt")
    out, fresh = extraction.map_reduce(docs, specs, e, chunk_chars=4)
    want = [(1, "s", "ONE\n\n---\n"), (2, "s", "TWO")]
    assert as_rows(out) == want and fresh.count() == 3
    silent = extraction.Extractor(lambda p, t: 1 / 0, "prompt")
    again, none = extraction.map_reduce(docs, specs, silent, cache=spark.createDataFrame(fresh.collect(), fresh.schema), chunk_chars=4)
    assert as_rows(again) == want and none.count() == 0
    tail = lambda d: d.withColumn("content", F.concat(F.lit("!"), "content"))
    joined = lambda d: d.select("doc", "section", F.length("joined").cast("string").alias("content"))
    assert as_rows(extraction.map_reduce(docs, specs, e, reducer=joined, post_process=tail, chunk_chars=4)[0]) == [(1, "s", "!25"), (2, "s", "!3")]


def test_check_registry(spark):
    c = checks.built_in()
    assert len(c.names()) == 7 and c.chosen(["coverage", "coverage"]) == ["coverage"] and c.chosen(configured=["faithfulness"]) == ["faithfulness"]
    with pytest.raises(ValueError):
        c.check("coverage")(lambda *a: None)
    for bad in (lambda: c.get("none"), lambda: c.chosen(["coverage", "none"])):
        with pytest.raises(KeyError, match="coverage"):
            bad()
    c.check("mine")(lambda cases, runs, events, measured, by: runs.select(*by, F.lit("mine").alias("check"), F.lit("pass").alias("status"), F.lit("").alias("detail")))
    runs = spark.createDataFrame([("c", "s")], "case_id string, session_id string")
    assert [r.status for r in c.run(runs, runs, runs, runs, ["mine"]).collect()] == ["pass"]


def test_columns_and_choices_of_a_suite(spark):
    results = spark.createDataFrame([("c", "z", "pass", "", 1), ("c", "a", "fail", "x", 2)], "case_id string, check string, status string, detail string, n int")
    assert evidence.columns_of(results, "n") == ["z", "a"] and evidence.scorecard(results).columns == ["case_id", "a", "z", "passed"]
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    assert evidence.chosen_cases(cases, None).count() == 2 and evidence.chosen_cases(cases, ["a"]).count() == 1
    with pytest.raises(ValueError, match="x"):
        evidence.chosen_cases(cases, ["a", "x"])


LOG = "session_id string, seq int, type string, name string, args string, call_id string, result string, query string, text string, question string, message string, mode string, source string, locator string, value string, ts timestamp, turn int"


def log(spark, rows):
    names = [c.split()[0] for c in LOG.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], LOG)


def test_replay(spark, as_rows):
    call = lambda seq, cid, args, name="find": {"session_id": "s", "seq": seq, "type": "tool_call", "name": name, "args": args, "call_id": cid}
    result = lambda seq, cid, r: {"session_id": "s", "seq": seq, "type": "tool_result", "call_id": cid, "result": r}
    rows = [{"session_id": "s", "seq": 0, "type": "user_query", "query": "q"}, call(1, "a", '{"x": 1, "y": {"b": 1, "a": 2}}'), call(2, "b", '{"y": {"a": 2, "b": 1}, "x": 1}'), result(3, "b", "second"), result(4, "a", "first"),
            call(5, "c", '{"text": "note"}', "save_note"), {"session_id": "s", "seq": 6, "type": "steering", "message": "m", "mode": "now"}, {"session_id": "s", "seq": 7, "type": "citation", "source": "d", "locator": '{"p": 1}', "value": "5"},
            {"session_id": "s", "seq": 8, "type": "citation", "source": "d", "locator": '{"p": 1}', "value": "5"}, {"session_id": "s", "seq": 9, "type": "final_answer", "text": "done"}, {"session_id": "t", "seq": 0, "type": "error"}]
    state = replay.replayed(log(spark, rows))
    assert as_rows(state.results, "seq", "ordinal", "result") == [(1, 1, "second"), (2, 2, "first")]
    assert as_rows(state.notes) == [("s", 5, "note")] and as_rows(state.citations, "cite", "times") == [("d#p=1", 2)]
    assert as_rows(state.history, "position", "role") == [(1, "user"), (2, "assistant"), (3, "assistant"), (4, "tool"), (5, "tool"), (6, "assistant"), (7, "assistant")]
    assert {r.session_id: r.error is None for r in state.sessions.collect()} == {"s": True, "t": False}
    assert as_rows(replay.steered(log(spark, rows)), "round", "message", "position") == [(1, "m", 1)]
    again = replay.replayed(log(spark, rows[::-1]))
    assert as_rows(again.history) == as_rows(state.history)
    assert as_rows(sessions.call_ordinals(log(spark, rows)), "seq", "ordinal") == [(1, 1), (2, 2), (5, 1)]


def test_recent_notes_keep_the_newest(spark):
    rows = [{"session_id": "s", "seq": i, "type": "tool_call", "name": "save_note", "args": json.dumps({"text": f"n{i}"})} for i in range(25)]
    assert sorted(r.note for r in sessions.recent_notes(log(spark, rows)).collect()) == sorted(f"n{i}" for i in range(5, 25))


def test_canonical_forms(spark):
    texts = ['{"b": 1, "a": {"z": 1.50, "y": [true, null, {"q": 1, "p": "é"}]}, "t": true, "n": null, "s": "x"}', "{}", "no", "[1]", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(evidence.canonical(F.col("t"))).collect()]
    assert got == ['a={"y":[true,null,{"p":"é","q":1}],"z":1.5}&b=1&n=None&s=x&t=True', "", "", "", ""]
    assert df.select(evidence.locator_line(F.col("t"))).first()[0].endswith("b=1 · s=x · t=True")
    numbers = spark.createDataFrame([(x,) for x in (0.5, 1234567.5, 1e-5, 0.1, -2.25)], "x double")
    assert [r[0] for r in numbers.select(evidence.six_digits(F.col("x"))).collect()] == ["0.5", "1.23457e+06", "1e-05", "0.1", "-2.25"]


def test_markup():
    page = "<html><head><title>T</title></head><body><p>One&nbsp;&amp; two</p><script>x < y</script><div>Three<br/>four &#233; &lt;b&gt;</div><td>five</td><!-- no --></body></html>"
    assert markup.shown_text(page) == "\nOne & two\nThree\nfour é <b>\nfive" and markup.shown_text("") == "" and markup.shown_text("a < b") == "a < b"
    text = "Risk .... 12\n" + "... 4 " * 200 + "Risk factors are many and described here. " * 60
    assert markup.densest_slice(text, "Risk", 12) == "Risk factors" and markup.densest_slice(text, "none", 5) == "" and markup.densest_slice("", "x", 5) == ""
    brute = max((m.start() for m in re.finditer("Risk", text)), key=lambda s: (sum(map(str.isalpha, text[s : s + 1500])), -s))
    assert markup.densest_slice(text, "Risk", 1500) == text[brute : brute + 1500]
    assert markup.args_line({"limit": 5, "query": "a\nb", "offset": 0, "x": None, "deep": True}) == '"a b" · limit=5 · deep=True' and markup.args_line({}) == ""
    assert len(markup.args_line({"query": "q" * 90, "other": "o" * 90, "third": "t" * 20})) == 64


def test_scrubbed_leaves(spark):
    df = spark.createDataFrame([(t,) for t in ('{"k@x.y": ["a@b.c", 1, null, {"n": "a@b.c d"}]}', "plain a@b.c", None)], "t string")
    assert [r[0] for r in df.select(markup.scrubbed_json(F.col("t"), [r"\S+@\S+"], "#")).collect()] == ['{"k@x.y": ["#", 1, null, {"n": "# d"}]}', "plain #", None]


def test_pdf_text():
    import zlib

    body = b"BT /F1 12 Tf (Hello \\(world\\)) Tj 0 -14 Td (line\\0402) Tj ET"
    packed = zlib.compress(body)
    raw = b"%PDF-1.4\n4 0 obj\n<< /Length 9 /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream\nendobj\n5 0 obj\n<< /Length 3 >>\nstream\nBT <0048> Tj ET\nendstream\n%%EOF"
    assert markup.pdf_text(raw) == "Hello (world)\nline 2\fH" and markup.pdf_text(b"") == ""


def test_front_matter_lines(spark):
    texts = ["---\ntitle: a --- b\nx: 1---\n---\nbody", "---\na: [1\n---\nx", "---\n- 1\n---\n", "---\r\na: 1\r\n---\r\nb", "x\n---\na: 1\n---\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(readers.front_matter(F.col("t"))).collect()] == ["title: a --- b\nx: 1---", "a: [1", "- 1", "a: 1", None, None]
    got = [r[0] for r in df.select(readers.front_matter_json(F.col("t"))).collect()]
    assert [json.loads(x) if x else None for x in got] == [{"title": "a --- b", "x": "1---"}, None, None, {"a": 1}, None, None]


def test_sources_are_sorted_and_texts_read(spark, tmp_path):
    for name, text in (("b.md", "---\nk: v\n---\nbody"), ("a.html", "<p>hi</p>"), ("c.xyz", "no"), ("sub/d.TXT", "t")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert [r.source.rsplit("/", 1)[-1] for r in readers.sources(spark, str(tmp_path)).collect()] == ["a.html", "b.md", "d.TXT"]
    rows = {r.filename: r for r in readers.texts_of(readers.load(spark, str(tmp_path))).collect()}
    assert rows["a.html"].text == "\nhi" and json.loads(rows["b.md"].frontmatter) == {"k": "v"} and rows["d.TXT"].text == "t"
    (tmp_path / "cases.yaml").write_text("cases:\n- id: a\n  query: q\n")
    assert readers.cases_file(spark, str(tmp_path / "cases.yaml")).first().case_id == "a"


def test_events_as_lines_and_back(spark, tmp_path):
    rows = log(spark, [{"session_id": "s", "seq": 1, "type": "user_query", "query": "é \"x\"\n"}, {"session_id": "s", "seq": 2, "type": "tool_call", "args": '{"a":1}'}])
    readers.event_lines(rows).select("line").write.text(str(tmp_path / "l"))
    good, bad = readers.session_logs(spark, str(tmp_path / "l"))
    assert bad.count() == 0 and sorted((r.seq, r.query, r.args) for r in good.collect()) == [(1, 'é "x"\n', None), (2, None, '{"a":1}')]


def test_surfaces_skills_and_imports(spark):
    a, b = catalog.Tool("a"), catalog.Tool("b")
    assert [t.name for t in catalog.surface((a,), (b,))] == ["a", "b"]
    with pytest.raises(ValueError):
        catalog.surface((a,), (b, a))
    assert catalog.imported("json:dumps") is json.dumps and catalog.imported("json.dumps") is json.dumps
    for bad in ("", "json", "json:none", "no_such_module:x", None):
        with pytest.raises(ValueError):
            catalog.imported(bad)
    skills = (catalog.Skill("z", "does z", "\n   Do z.\n     Then more.\n", ("a", "gone")), catalog.Skill("y", "does y", "Do y."))
    assert catalog.load_skill(skills, "z") == {"skill": "z", "instructions": "Do z.\n  Then more."} and catalog.load_skill(skills, "x")["available_skills"] == ["y", "z"]
    assert catalog.composed_role("Role.\n", ()) == "Role.\n" and catalog.composed_role("Role.\n", skills).startswith("Role.\n\n## Available skills\n\n") and catalog.composed_role(" ", skills).endswith("- z: does z\n- y: does y")
    assert catalog.missing_tools(catalog.skill_table(spark, skills).select("skill", "tool").filter("tool is not null"), catalog.tools(spark, (a,))).collect()[0].tool == "gone"
    e = spark.createDataFrame([(1, "red")], "id int, text string")
    assert catalog.BM25Index().search(e, "red", 5).count() == 1


def test_schemas():
    s = artifacts.MIXED.json_schema()
    assert s["properties"]["sections"]["required"] == ["overview/topic_summary"] and s["properties"]["sections"]["additionalProperties"] == {"type": "string"} and s["properties"]["json_artifacts"]["required"] == ["metadata.json"]
    assert artifacts.DOCUMENTS.spec_of("sections/x").name == "sections/*" and artifacts.DOCUMENTS.spec_of("other") is None


def test_nested_settings(tmp_path):
    from spindrift.sources.config import settings, settings_file

    (tmp_path / "f.yaml").write_text("model: {provider: p, name: n}\ntools: {fs: {roots: {a: x}}}\neval: {checks: [coverage]}\n")
    s, origin = settings_file(str(tmp_path / "f.yaml"))
    assert s.model.effort == "medium" and s.tools.fs.roots == {"a": str(tmp_path / "x")} and s.eval.checks == ["coverage"]
    assert origin["model.name"] == "file" and origin["model.effort"] == "default" and origin["max_iterations"] == "default"
    for bad in ({"model": {"provider": "p"}}, {"model": {"provider": "p", "name": "n", "x": 1}}, {"tools": {"fs": {}}}, {"max_iterations": 0}, {"oracle": {"provider": "p", "model": "m", "effort": "huge"}}):
        with pytest.raises(ValueError):
            settings(bad)


def test_listing_several_roots(spark, as_rows):
    make = lambda *ps: spark.createDataFrame([(p, 1) for p in ps], "path string, size bigint")
    roots = {"b": make("x.md", "s/y.md"), "a": make("z.md")}
    from spindrift.operators import trees

    assert as_rows(trees.fs_ls(roots)) == [("a", "dir", None), ("b", "dir", None)] and as_rows(trees.fs_ls(roots, "b"), "name", "type") == [("s", "dir"), ("x.md", "file")]
    assert as_rows(trees.fs_ls(roots, "b/s"), "name") == [("y.md",)] and as_rows(trees.fs_ls({"": roots["a"]}), "name") == [("z.md",)]


def test_compaction_registered_citations_and_identities(spark, as_rows):
    from spindrift.operators import ingestion

    rows = [{"session_id": "s", "seq": i, "type": "user_query", "query": f"q{i}"} for i in range(5)] + [{"session_id": "s", "seq": 9 + i, "type": "tool_call", "name": "register_citation", "args": '{"source": "d", "locator": {"p": 1}, "value": 5}'} for i in range(2)]
    mine = lambda t: t.groupBy("session_id").agg(F.count("*").cast("string").alias("digest"))
    got = as_rows(sessions.compacted(log(spark, rows), 2, mine), "seq", "content")
    assert (-1, "7") in got and len(got) == 3
    assert as_rows(evidence.registered(log(spark, rows)), "seq", "cite", "value") == [(9, "d#p=1", "5")]
    loads = spark.createDataFrame([("in/ACME/2024/report.v1.html",), ("x.md",), (".env",)], "source string")
    assert [(r.identifiers, r.source_id) for r in ingestion.identified(loads).collect()] == [({"ticker": "ACME", "year": "2024"}, "report.v1"), ({"ticker": None, "year": None}, "x"), ({"ticker": None, "year": None}, ".env")]


def test_hooks_at_points(spark):
    h = catalog.Hooks()
    h.at("after_tool_call").transforms.append(lambda d: d.withColumn("x", F.lit(1)))
    h.at("on_event").transforms.append(lambda d: d.withColumn("y", F.lit(1)))
    assert h.passed("after_tool_call", spark.range(1)).columns == ["id", "x"] and h.passed("on_event", spark.range(1)).columns == ["id"] and h.passed("before_tool_call", spark.range(1)).columns == ["id"]
    with pytest.raises(ValueError):
        h.at("nowhere")


def test_fan_out_and_appended_logs(spark, tmp_path):
    from spindrift.sinks import writers

    seen = []
    writers.fan_out(spark.range(3), lambda d: seen.append(d.count()), lambda d: seen.append(d.count()))
    assert seen == [3, 3]
    with pytest.raises(ZeroDivisionError):
        writers.fan_out(spark.range(3), lambda d: 1 / 0, lambda d: seen.append(d.count()))
    assert len(seen) == 2
    one = log(spark, [{"session_id": "s", "seq": 1, "type": "error"}])
    for _ in range(2):
        writers.append_events(one, str(tmp_path / "logs"))
    assert spark.read.json(str(tmp_path / "logs")).count() == 2
