import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import decoding, text
from spindrift.operators import catalog, files, search, truncation
from spindrift.operators.sessions import valid_id

ODD = ["", " ", "Straße", "a\r\nb\nc\x0bd\x0ce\x1cf\x85g h", "end\n", "😀 astral", "x" * 5000, "Total 1,234", "\r\n\r\n"]


def apply(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_lines_as_splitlines(spark):
    assert apply(spark, ODD, text.lines) == [v.splitlines() for v in ODD]
    assert apply(spark, [None], text.lines) == [None]


def test_tokens(spark):
    assert apply(spark, ["Ärger_1 über 2x!", "", None], text.tokens) == [["ärger_1", "über", "2x"], [], []]
    assert apply(spark, ["a A b-a", None], lambda c: text.term_count(F.lower(c), "a")) == [3, 0]


def test_stripped(spark):
    assert apply(spark, ["  x\x1f\x85 ", "\x0b", "a b"], text.stripped) == ["x", "", "a b"]


def test_numeric_claims(spark):
    values = ["**1,234** in 2022-23 and SKU-0497", "$31.4B, (325) 12.5% in 2019", "2,019.", "1.5 thousand 3k -7", "", None]
    assert apply(spark, values, text.numeric_claims) == [[1234.0], [31.4e9, 325.0, 12.5], [], [1.5, 3000.0, 7.0], [], []]


def test_packed_pages(spark):
    def brute(t, size):
        out, cur, n = [], [], 0
        for p in (x.strip() for x in t.split("\f")):
            if not p:
                continue
            if cur and n + len(p) > size:
                out.append("\n\n".join(cur))
                cur, n = [], 0
            cur.append(p)
            n += len(p)
        return out + (["\n\n".join(cur)] if cur else [])

    values = ["aaa\fbb\f\f c \fdddddddd\fe", "", "\f\f", "one", "x" * 30 + "\fy"]
    assert apply(spark, values, lambda c: text.packed_pages(c, 6)) == [brute(v, 6) for v in values]


def test_html(spark):
    html = "<html><head><title>t</title></head><body><script>x<y</script><p>A &amp; B</p>\n<p>C&nbsp;D</p></body></html>"
    assert apply(spark, [html, "", "plain"], text.html_text) == ["A & B\n\nC D", "", "plain"]


def test_scrub_and_fences(spark):
    assert apply(spark, ["a 123-45-6789 b"], lambda c: text.scrubbed(c, [r"\d{3}-\d{2}-\d{4}"])) == ["a [REDACTED] b"]
    assert apply(spark, ['```json\n{"a": 1}\n```', ' {"b": 2} ', ""], text.fenced_json) == ['{"a": 1}', '{"b": 2}', ""]


def test_snippets(spark):
    long = "word " * 60 + "needle" + " tail" * 60
    got = apply(spark, [long, "no match " * 40, "", "needle"], lambda c: text.snippet(c, ["needle"]))
    assert got[0].startswith("…word") and got[0].endswith("tail…") and "needle" in got[0]
    assert got[1] == ("no match " * 40)[:240].strip() + "…" and got[2] == "" and got[3] == "needle"


@pytest.mark.parametrize(
    ("raw", "kind", "want"),
    [(b"\xef\xbb\xbfhi", None, "hi"), ("hé".encode("utf-16-le"), "text/plain; charset=utf-16le", "hé"), (b"h\xe9", "text/html; charset=ISO-8859-1", "hé"), (b"a\xffb", None, "a�b"), (b"", "x; charset=nonsense", ""), (None, None, None), (b"\xff\xfea\x00", "text/plain", "a")],
)
def test_decoding(raw, kind, want):
    assert decoding.decode_bytes(raw, kind) == want


def test_paths(spark):
    bad = ["", "/x", "..", "a/../../b", "../a"]
    good = ["a", "a/../b", "./a", "a/b/c"]
    assert apply(spark, bad + good, files.escapes) == [True] * len(bad) + [False] * len(good)
    assert apply(spark, ["a/.git/x", ".hid/x", "node_modules/x", "a/b"], files.ignored) == [True, True, True, False]
    assert apply(spark, [".hid/x", ".git/x"], lambda c: files.ignored(c, True)) == [False, True]
    assert apply(spark, ["a/B.TXT", "a", ".env", "x.tar.gz"], files.suffix) == [".txt", "", "", ".gz"]


@pytest.mark.parametrize(("pattern", "yes", "no"), [("**/*.md", ["a.md", "a/b.md"], ["a.txt"]), ("src/*.p?", ["src/a.py"], ["src/a/b.py", "src/a.p"]), ("[!a]*", ["b"], ["a", "ab"]), ("a.b", ["a.b"], ["axb"])])
def test_globs(pattern, yes, no):
    r = re.compile(files.glob_regex(pattern))
    assert all(r.match(x) for x in yes) and not any(r.match(x) for x in no)
    with pytest.raises(ValueError):
        files.glob_regex("/" + pattern)


def test_grep_cap_and_case(spark):
    df = spark.createDataFrame([("a", "x\nSTRASSE x\n"), ("b", "Straße"), ("c", None)], "path string, content string")
    assert [(r.path, r.line_no) for r in files.matching_lines(df, "straße", True).orderBy("path").collect()] == [("a", 2), ("b", 1)]
    assert [r.truncated for r in files.grep(df, "x", cap=2).collect()] == [True, True]
    assert [r.truncated for r in files.grep(df, "x", cap=3).collect()] == [False, False]
    with pytest.raises(ValueError):
        files.grep(df, "")


def test_read_slices(spark):
    df = spark.createDataFrame([("a", "abcdef")], "path string, content string")
    r = files.read_slice(df, 4, 10).first()
    assert (r.content, r.has_more, r.total_size) == ("ef", False, 6)
    for o, n in ((-1, 5), (0, 0)):
        with pytest.raises(ValueError):
            files.read_slice(df, o, n)


def test_json_fields(spark):
    df = spark.createDataFrame([('{"b": null, "a": {"x": 1}}',), ("[1]",), (None,)], "p string")
    a, b, c = files.json_fields(df, "p", ["z", "a"]).collect()
    assert (a.field_a, a.available_keys, a.missing_keys) == ('{"x":1}', "a,b", "z") and b.available_keys is None and c.field_a is None


def entries(spark):
    return spark.createDataFrame([(1, "red red blue", "en"), (2, "blue", None), (3, "", "en"), (4, None, "de"), (5, "green blue red", "de")], "id int, text string, lang string")


def test_bm25_edges(spark):
    e = entries(spark)
    assert [r.id for r in search.bm25(e, "red").collect()] == [1, 5]
    assert search.bm25(e, "absent").count() == 0
    twice, once = search.bm25(e, "red red").first().score, search.bm25(e, "red").first().score
    assert abs(twice - 2 * once) < 2e-6
    assert [r.id for r in search.bm25(e, "blue", {"lang": ["en", "fr"]}, attributes=("lang",)).collect()] == [1]
    assert search.clamp_k(0) == 5 and search.clamp_k(-1) == 5 and search.clamp_k(21) == 20
    with pytest.raises(ValueError):
        search.bm25(e, " ! ")
    with pytest.raises(ValueError):
        search.filtered_search(e, {"lang": []})
    asked = spark.createDataFrame([("q", "red red"), ("none", "absent"), ("blank", " ! "), ("p", "blue")], "query_id string, query string")
    batch = search.bm25_batch(e, asked, 2).collect()
    assert [(r.id, r.rank) for r in sorted(batch, key=lambda r: r.rank) if r.query_id == "q"] == [(1, 1), (5, 2)] and {r.query_id for r in batch} == {"q", "p"}
    assert abs(next(r.score for r in batch if r.query_id == "q" and r.rank == 1) - twice) < 1e-5
    assert sorted(map(tuple, search.bm25_batch(e, asked, 2, block_queries=1).collect())) == sorted(map(tuple, batch))
    assert search.bm25_batch(e, asked.limit(0)).count() == 0 and search.bm25_batch(e.limit(0), asked).count() == 0 and search.bm25(e.limit(0), "red").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text(max_size=40), lambda x: st.lists(x, max_size=5) | st.dictionaries(st.text(max_size=5), x, max_size=5), max_leaves=12), st.integers(0, 300))
def test_truncation_within_budget(value, limit):
    out, cut = truncation.within(value, limit)
    assert cut == (limit > 0 and len(json.dumps(value)) > limit)
    if not cut:
        assert out == value
    elif limit >= 150 and not isinstance(value, (dict, list)):
        assert len(json.dumps(out)) <= limit + 60 or isinstance(value, str)


def test_truncation_shapes():
    out, cut = truncation.within(list(range(50)), 100)
    assert cut and out["_original_count"] == 50 and out["items"] == list(range(len(out["items"]))) and len(json.dumps(out)) <= 100 + len(out["items"])  # a separator counts one
    out, _ = truncation.within({f"k{i}": "v" * 30 for i in range(50)}, 1200)
    assert len(out["_original_keys"]) == 50 and out["available_keys"]
    assert truncation.within("x" * 100, 50)[0] == "x" * 35 + "... [truncated]"
    assert truncation.within("x" * 100, 0) == ("x" * 100, False)


def test_truncation_column(spark):
    got = apply(spark, [json.dumps(["a" * 60] * 9), "no json " * 30, None, "{}"], lambda c: truncation.truncated_json(c, 120))
    assert json.loads(got[0])["_original_count"] == 9 and json.loads(got[1]).endswith(truncation.MARK) and got[2] is None and got[3] == "{}"


def test_ids(spark):
    assert apply(spark, ["a-B_9", "", "a b", None, "a\n"], valid_id) == [True, False, False, False, False]


def test_registry():
    r = catalog.Registry()

    def good(*, query: str, k: int = 5):
        return query * k

    r.add(good)
    assert r.run("good", {"query": "a", "k": 2}) == "aa"
    for name, args, error in (("good", {}, ValueError), ("good", {"query": "a", "x": 1}, ValueError), ("none", {}, KeyError)):
        with pytest.raises(error):
            r.run(name, args)
    with pytest.raises(ValueError):
        r.add(good)
    with pytest.raises(TypeError):
        r.add(lambda query: query)


def test_hooks(spark):
    h = catalog.Hooks()
    h.transforms.append(lambda df: df.withColumn("b", F.lit(1)))
    h.observers.append(lambda df: 1 / 0)
    assert h.apply(spark.range(2)).columns == ["id", "b"]
