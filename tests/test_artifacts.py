import json

import pytest
from pyspark.sql import functions as F

from spindrift.operators import artifacts as A
from spindrift.operators import ingestion


def test_schemas():
    s = A.Schema.parsed({"sections": ["a", {"name": "b", "required": True, "max_chars": 5}, "c/*"], "json_artifacts": [{"name": "m.json", "fields": {"n": "int", "t": "str"}}]})
    assert [x.name for x in s.sections] == ["a", "b", "c/*"] and s.payloads[0].needed == ("n", "t")
    js = s.json_schema()["properties"]
    assert js["sections"]["required"] == ["b"] and "c/*" not in js["sections"]["properties"] and js["json_artifacts"]["properties"]["m.json"]["required"] == ["n", "t"]
    mixed = s.layered((A.Section("summary", True), A.Section("a")))
    assert [(x.name, x.required) for x in mixed.sections] == [("summary", True), ("a", False), ("b", False), ("c/*", False)] and mixed.payloads[0].needed == ()
    assert s.rendered() == "- a (no limit)\n- b (<=5 chars)" and s.struct("m.json").simpleString() == "struct<n:bigint,t:string>"
    for bad in ({"sections": [{"name": "x/*", "required": True}]}, {"sections": ["a", "a"]}, {"entity_path": "none"}, {"json_artifacts": ["x"]}, {"json_artifacts": [{"name": "x.json", "fields": {"a": "decimal"}}]}, {"json_artifacts": [{"name": "x.json", "required_fields": ["a"]}]}):
        with pytest.raises(ValueError):
            A.Schema.parsed(bad)


def test_templates(spark):
    assert A.template_keys("{a}/x/{b}/{a}") == ("a", "b")
    df = spark.createDataFrame([("1", "2")], "a string, b string")
    assert df.select(A.template_path("r/{a}-{b}", {"a": F.col("a"), "b": F.col("b")})).first()[0] == "r/1-2"
    for values in ({"a": F.col("a")}, {"a": F.col("a"), "b": F.col("b"), "c": F.col("a")}):
        with pytest.raises(ValueError):
            A.template_path("{a}/{b}", values)


def test_payload_errors(spark):
    spec = A.Payload("m.json", {"n": "int", "f": "float", "t": "str"}, ("n",))
    cases = {
        '{"n": 1, "f": 1.5, "t": "x"}': [],
        '{"n": null}': [],  # present but null
        '{"n": true}': [],  # true is a whole number
        '{"t": "x"}': ["m.json misses n"],
        '{"n": "1", "f": 2}': ["m.json field n: expected integer, got string", "m.json field f: expected number, got bigint"],
        "[1]": ["m.json must be an object"],
        "broken": ["m.json must be an object"],
        None: ["missing required m.json"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string").select(A.payload_errors(F.col("p"), spec))
    assert [r[0] for r in df.collect()] == list(cases.values())


def test_stubs_and_lines(spark):
    values = ['{"a": 1}', "[1]", '"x"', "3", "no json", '{"_truncated": true, "available_keys": ["k"], "z": 1}']
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "r string").select(A.compacted_stub(F.col("r"))).collect()]
    assert got == [f"compacted-result {x}" for x in ("dict", "list", "str", "int", "(opaque)", 'keys=["k"]')]
    r = json.dumps({"hits": [1, 2], "content": "x" * 2048, "has_more": True})
    assert spark.createDataFrame([(r,)], "r string").select(A.result_line(F.col("r"), F.lit(True))).first()[0] == "2 hits · 2.0 KB · more available · truncated"


def test_map_reduce_answers_equal_chunks_once(spark):
    docs = spark.createDataFrame([(1, "a b\fc d e"), (2, "a b"), (3, None), (4, "")], "doc_id long, text string")

    def fails_on_c(text):
        if text.startswith("c"):
            raise ValueError("no")
        return ingestion.stub_adapter(text)

    got = {r.doc_id: r for r in A.map_reduced(docs, fails_on_c, size=3).collect()}
    assert set(got) == {1, 2} and got[1].chunks == 2
    assert json.loads(got[2].summary) == {"summary": "a b", "words": 2}


def test_routes():
    assert ingestion.routes()[".htm"] == "html"
    with pytest.raises(ValueError):
        ingestion.routes({"a": (".x",), "b": (".X",)})


def test_extraction_errors_are_rows(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in ingestion.extracted(docs, lambda t: 1 / 0).collect()] == [(1, None, "ZeroDivisionError: division by zero")]
