import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import splitting as S


def check(text, limit, overlap):
    parts = S.split_text(text, limit, overlap)
    assert "".join(text[s:e] for _, s, e in parts) == text
    ov = overlap
    for k, (f, s, e) in enumerate(parts):
        assert e - f <= limit or len(text) <= limit
        assert s - f == (min(ov, s) if k else 0)
    return parts


@settings(max_examples=150, deadline=None)
@given(st.text("ab .\n,;\f#!éñ😀", max_size=400), st.integers(1, 60), st.integers(0, 50))
def test_pieces_fit_and_join_to_the_text(text, limit, overlap):
    if overlap < limit:
        check(text, limit, overlap)
    else:
        with pytest.raises(ValueError):
            S.split_text(text, limit, overlap)


def test_cuts_at_natural_places():
    text = "First sentence here. Second one follows.\n\nNew paragraph starts. It ends."
    parts = check(text, 45, 0)
    assert [text[s:e].strip() for _, s, e in parts] == ["First sentence here. Second one follows.", "New paragraph starts. It ends."]
    words = "alpha beta gamma delta"
    assert [words[s:e] for _, s, e in check(words, 12, 0)] == ["alpha beta ", "gamma delta"]


def test_long_texts_without_any_boundary():
    parts = check("x" * 100_000, 1000, 100)
    assert len(parts) == 1 + -(-(100_000 - 900) // 900)


def test_no_limit_and_empty():
    assert S.split_text("", 5) == [(0, 0, 0)] and S.split_text("abc", None) == [(0, 0, 3)] and S.split_text("abc", 0) == [(0, 0, 3)]


def test_weakest_boundaries_go_first():
    rnd = random.Random(1)
    text = "".join(rnd.choice(["Some words here. ", "More of it, ", "End.\n\n", "Line\n"]) for _ in range(200))
    parts = check(text, 300, 20)
    places = {p: s for p, s in S.segment(text, 280)}
    cut = [places[s] for _, s, _ in parts[1:]]
    assert sum(cut) / len(cut) > sum(places.values()) / len(places)


def test_operator(spark, as_rows):
    specs = spark.createDataFrame([("a", True, 20, 5), ("a*", False, 30, 0), ("*", False, None, None)], "name string, required boolean, max_chars int, overlap_chars int")
    text = b"One two three. Four five six. Seven."
    data = [(1, "a", text, None, 9), (2, "ab", text, None, 9), (3, "zz", text, None, 9), (4, None, text, None, 9), (5, "a", None, None, 9), (6, "a", b"", None, 9), (7, "a", "é".encode("utf-16-le") * 30, "text/plain; charset=utf-16le", 9), (7, "a", b"x", None, 9)]
    loads = spark.createDataFrame(data, "load_id long, section string, raw binary, content_type string, max_chars int")
    out = S.split_documents(loads, specs)
    found = as_rows(out.filter("pieces > 1 and piece = 0"), "load_id", "spec_name")
    assert found == [(1, "a"), (2, "a*"), (7, "a")]
    assert as_rows(out.filter("pieces = 1"), "load_id", "spec_name", "n_chars") == sorted([(3, "*", 36), (4, None, 36), (6, "a", 0), (7, "a", 1)], key=repr)
    first = {r.piece: r for r in out.filter("load_id = 1").collect()}
    assert first[1].text[: first[1].repeated] == first[0].text[-first[1].repeated :] and all(r.n_chars <= 20 for r in first.values())
    assert S.split_documents(loads.limit(0), specs).count() == 0
    assert as_rows(S.split_documents(loads, specs, broadcast_sections=0)) == as_rows(out)  # salted join with the specs
    with pytest.raises(ValueError):
        S.split_documents(loads, specs.selectExpr("name", "required", "max_chars", "20 AS overlap_chars"))


def test_payloads_do_not_meet_their_specs_in_a_shuffle(spark):
    specs = spark.createDataFrame([("a*", 20, 5)], "name string, max_chars int, overlap_chars int")
    loads = spark.range(1000).selectExpr("id AS load_id", "'ab' AS section", "cast('text' AS binary) AS raw", "cast(null AS string) AS content_type")
    plan = S.split_documents(loads, specs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(section" not in plan and "SortMergeJoin" not in plan
