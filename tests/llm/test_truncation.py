from spindrift.llm import truncation as T

SCHEMA = "action_id long, source string, text string, ending string, cut boolean"


def frame(spark, texts, source="s"):
    return spark.createDataFrame([(i, source, t, "x", None) for i, t in enumerate(texts)], SCHEMA)


WHOLE = ["A full sentence.", "Is it? ✅", "As said (see A/2020). [3]", "See this. (see A/b)", "“Quoted.”", "Text:\n\n```json\n{\"a\": 1}\n```", '{"answer": "x.", "n": [1]}', "| a | b |\n|---|---|\n| c | 1 |", "- a: $1,200\n- b: $3,400\n- c: $5,600", "Sum.\n\nTotal: 640,231", "Fertig in 2021.", "Ends here.\n\n"]
CUT = ["A full sentence. And ano", "It rose by 12", "Eine Abschreibung von 12,3 Mio.", "Text:\n\n```json\n{\"a\": 1", '{"answer": "x', "| a | b |\n|---|---|\n| c | 1", "| a | b |\n|---|---|\n| c |", "- a: $1,200\n- b: $3,400\n- c: $5,6", "So far (see", "“Quoted", "The end is…", "Not all of it [truncated]", "Sum of it (cut)", "worth $411.", "half �"]


def test_endings(spark):
    got = {r.action_id: r.cut for r in T.truncated(frame(spark, WHOLE + CUT)).collect()}
    wrong = [t for i, t in enumerate(WHOLE + CUT) if got[i] != (i >= len(WHOLE))]
    assert wrong == []


def test_limits_show_in_the_right_measure(spark):
    bodies = ["é" * (10 + i * 7 % 400) + "." for i in range(300)]
    texts = [b if len(b.encode()) < 500 else b.encode()[:500].decode(errors="ignore") for b in bodies]
    found = T.hidden_limits(frame(spark, texts)).filter("is_limit").collect()
    assert ("utf8_bytes", 500) in {(r.measure, r.limit_at) for r in found}
    assert T.hidden_limits(frame(spark, [f"Text {'x' * i}." for i in range(300)])).filter("is_limit").count() == 0


def test_measures_against_python(spark):
    import html
    import json

    texts = ["a<b>&\"c'\n\té", "😀\n\n", "plain"]
    own = {"characters": len, "utf8_bytes": lambda t: len(t.encode()), "utf16_units": lambda t: len(t.encode("utf-16-le")) // 2, "html_escaped": lambda t: len(html.escape(t)), "html_escaped_bytes": lambda t: len(html.escape(t).encode()), "json_escaped": lambda t: len(json.dumps(t, ensure_ascii=False)) - 2, "json_escaped_bytes": lambda t: len(json.dumps(t, ensure_ascii=False).encode()) - 2, "json_ascii": lambda t: len(json.dumps(t)) - 2, "crlf_characters": lambda t: len(t) + t.count("\n"), "crlf_bytes": lambda t: len(t.encode()) + t.count("\n")}
    from pyspark.sql import functions as F

    df = frame(spark, texts).orderBy("action_id")
    for name, c in T.measures(F.col("text")).items():
        assert [r[0] for r in df.select(c).collect()] == [own[name](t) for t in texts], name


def test_rates_nulls_and_empty_tables(spark):
    df = frame(spark, [None, "", "   ", "Whole.", "Whole.", "Not wh"]).unionByName(frame(spark, ["Cut of", "x" * 200_000], None))
    got = {r.source: (r.texts, r.cut_texts) for r in T.source_rates(df).collect()}
    assert got == {"s": (4, 1), None: (2, 2)}
    assert T.truncated(df.limit(0)).count() == 0 and T.source_rates(df.limit(0)).count() == 0


def test_hard_limits_decide_on_doubtful_endings(spark):
    entry = "- a: $1,200\n"
    short = [entry * k + "- b: $3,400" for k in range(2, 30)]
    full = [("Some words first. " * k + "\n")[-(400 - len(entry * 20 + "- b: $3,400")) :] + entry * 20 + "- b: $3,400" for k in range(40, 46)]
    assert {len(t) for t in full} == {400}
    rows = frame(spark, short + full, "capped").unionByName(frame(spark, short, "free"))
    found = T.truncated(rows).filter("cut").collect()
    assert len(found) == len(full) and {(r.source, r.ending, r.by) for r in found} == {("capped", "list_entry", "limit")}
    seen = T._examined(rows)
    assert T._judged(seen, T._limits(seen).filter("false")).filter("cut").count() == 0  # the endings alone say nothing


def test_half_characters_do_not_hide_a_limit(spark):
    texts = [("é" * 400 + "x" * i)[: 250 + i].encode()[:301].decode(errors="replace") for i in range(60)] + [f"Text {'x' * i}." for i in range(60)]
    texts += [("x" * i + "é" * 200).encode()[:301].decode(errors="replace") for i in range(60)]
    hard = {(r.measure, r.limit_at) for r in T.hidden_limits(frame(spark, texts)).filter("is_limit").collect()}
    assert ("utf8_bytes", 301) in hard


def test_long_words_and_lines(spark):
    got = {r.action_id: r.cut for r in T.truncated(frame(spark, ["- " + "x" * 50_000 + "\n- y", "w" * 300 + " ends here.", "w " * 50_000 + "end (see A/b)"])).collect()}
    assert got == {0: True, 1: False, 2: False}
