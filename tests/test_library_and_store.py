"""Entities, caches, files and sessions written and read again."""

import json

import pytest
from pyspark.sql import functions as F

from spindrift.operators import artifacts, sessions, trees
from spindrift.sinks import library, store
from spindrift.sources import readers
from spindrift.storage import Place

SCHEMA = artifacts.Schema("{ticker}/{year}", (artifacts.Section("summary", True, 20), artifacts.Section("sections/*")), (artifacts.Payload("metadata.json", {"n": "int"}),))
IDS = {"ticker": "ACME", "year": "2024"}


def test_entities_are_written_whole(spark, tmp_path):
    root = str(tmp_path)
    files = library.write_entity(spark, root, SCHEMA, IDS, {"summary": "Short.", "sections/a": "Ä"}, {"metadata.json": {"n": 1, "a": None}}, {"model": "m"})
    assert files == ["metadata.json", "sections/a", "summary"]
    at = tmp_path / "ACME/2024"
    assert (at / "sections/a").read_text() == "Ä" and json.loads((at / "metadata.json").read_text()) == {"a": None, "n": 1}
    told = json.loads((at / library.MANIFEST).read_text())
    assert told == {"schema_version": "1", "identifiers": IDS, "files": files, "extractor": {"model": "m"}}
    library.write_entity(spark, root, SCHEMA, IDS, {"summary": "New."})
    assert (at / "summary").read_text() == "New." and not (at / "sections").exists()
    for bad in ((IDS, {"other": "x"}), (IDS, {"summary": "x" * 21}), ({"ticker": "a/b", "year": "1"}, {}), ({"ticker": "A"}, {}), (IDS, {"sections/../../x": "y"})):
        with pytest.raises(ValueError):
            library.write_entity(spark, root, SCHEMA, *bad)
    assert (at / "summary").read_text() == "New."


def test_a_failed_write_leaves_the_old_entity(spark, tmp_path, monkeypatch):
    library.write_entity(spark, str(tmp_path), SCHEMA, IDS, {"summary": "Old."})
    move, calls = Place.move, []

    def broken(self, to):
        calls.append(1)
        if len(calls) == 2:  # the new folder into its place
            raise OSError("disk")
        move(self, to)

    monkeypatch.setattr(Place, "move", broken)
    with pytest.raises(OSError):
        library.write_entity(spark, str(tmp_path), SCHEMA, IDS, {"summary": "New."})
    assert (tmp_path / "ACME/2024/summary").read_text() == "Old."


def test_search_entries_and_sidecars(spark, tmp_path):
    df = spark.createDataFrame([({"year": "2024", "ticker": "ACME"}, [("b", "B"), ("a", "A")], {"url": "http://x", "source": ""})], "i map<string,string>, s array<struct<name:string,text:string>>, m map<string,string>")
    entry = df.select(*library.search_entry(F.col("i"), F.col("s"), F.col("m")))
    r = entry.first()
    assert (r.id, r.text, r.sections, r.source) == ("ACME/2024", "B\n\nA", {"a": "A", "b": "B"}, "http://x")
    path = str(tmp_path / "side.json")
    (tmp_path / "side.json").write_text("{broken")
    library.upsert_sidecar(spark, entry, path)
    library.upsert_sidecar(spark, entry.withColumn("text", F.lit("new")).unionByName(entry.withColumn("id", F.lit("AAA/1"))), path)
    assert [(r.id, r.text) for r in readers.sidecar(spark, path).collect()] == [("AAA/1", "B\n\nA"), ("ACME/2024", "new")]
    big = str(tmp_path / "entries")
    for text in ("old", "new"):
        library.upsert_entries(spark, entry.withColumn("text", F.lit(text)), big, 4)
    library.upsert_entries(spark, entry.withColumn("id", F.lit("AAA/1")), big, 4)
    assert sorted((r.id, r.text) for r in spark.read.parquet(big).collect()) == [("AAA/1", "B\n\nA"), ("ACME/2024", "new")]


def test_map_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert library.cached(spark, path) is None
    rows = lambda *r: spark.createDataFrame(r, "key string, answer string")
    library.cache_put(spark, rows(("a", '{"x": "1"}'), ("b", "broken")), path)
    library.cache_put(spark, rows(("a", '{"x": "2"}'), ("c", "{}")), path)
    assert sorted((r.key, r.answer) for r in library.cached(spark, path).collect()) == [("a", '{"x": "1"}'), ("c", "{}")]


def test_dead_letters_and_files_of_users(spark, tmp_path):
    try:
        raise ValueError("no good")
    except ValueError as e:
        at = library.dead_letter(spark, str(tmp_path / "dead"), "in/report.html", b"<p>", e, {"b": 1, "a": 2})
    folder = tmp_path / "dead/report"
    assert at.endswith("/report") and (folder / "raw.html").read_bytes() == b"<p>" and json.loads((folder / "payload.json").read_text()) == {"a": 2, "b": 1}
    assert json.loads((folder / "error.json").read_text())["error_type"] == "ValueError"
    roots = {"notes": str(tmp_path / "n"), "code": str(tmp_path / "c")}
    assert library.fs_write(spark, roots, "notes/a/b.md", "é", True) == {"path": "notes/a/b.md", "bytes_written": 2, "created": True}
    assert not library.fs_write(spark, roots, "notes/a/b.md", "x", True)["created"]
    for path, error in (("notes/a.bin", ValueError), ("other/a.md", ValueError), ("notes/../../a.md", ValueError), ("/a.md", ValueError)):
        with pytest.raises(error):
            library.fs_write(spark, roots, path, "x", True)
    with pytest.raises(PermissionError):
        library.fs_write(spark, roots, "notes/a.md", "x")


def test_session_store(spark, tmp_path):
    s = store.SessionStore(spark, str(tmp_path / "s"))
    kinds = ["user_query", "tool_call", "final_answer", "user_query", "final_answer"]
    rows = [("abc1", i, k, f"2026-01-01T00:00:0{i}Z") for i, k in enumerate(kinds)]
    s.append(spark.createDataFrame(rows, "session_id string, seq int, type string, ts string").withColumn("ts", F.col("ts").cast("timestamp")))
    meta = s.read_meta("abc1")
    assert (meta["event_count"], meta["parent_id"], meta["title"]) == (5, None, None) and meta["created"].startswith("2026-01-01T00:00:00")
    s.set_title("abc1", "A title", "2026-02-01T00:00:00Z")
    assert s.read_meta("abc1")["title"] == "A title" and s.read_meta("abc1")["created"] == meta["created"]
    with pytest.raises(ValueError):
        s.write_meta("abc1", meta | {"session_id": "other"})
    (tmp_path / "s/meta/abc1.json").write_text(json.dumps(meta | {"schema_version": 9}))
    with pytest.raises(ValueError):
        s.read_meta("abc1")
    s.write_meta("abc1", meta)
    assert s.fork("abc1", 2, "abc2", "2026-03-01") == 3 and s.read_meta("abc2")["parent_id"] == "abc1"
    assert {r.session_id for r in s.events("abc2").collect()} == {"abc2"} and s.fork("abc1", -1, "abd", "x") == 5
    for bad in (0, 3, -2):
        with pytest.raises(ValueError):
            s.fork("abc1", bad, "new", "x")
    assert s.resolve("abd") == "abd" and s.resolve("abc1") == "abc1"
    for prefix in ("ab", "zz"):
        with pytest.raises(ValueError):
            s.resolve(prefix)
    out = str(tmp_path / "out")
    s.export("abc2", out)
    with pytest.raises(FileExistsError):
        s.import_(out)
    t = store.SessionStore(spark, str(tmp_path / "t"))
    assert t.import_(out) == "abc2" and t.events("abc2").count() == 3 and t.read_meta("abc2")["parent_id"] == "abc1"
    with pytest.raises(FileExistsError):
        s.export("abc2", out)
    with pytest.raises(ValueError):
        s.exists("../x")


def test_unknown_versions_raise(spark):
    meta = spark.createDataFrame([("a", 2), ("b", 7)], "session_id string, schema_version int")
    assert sessions.versions_checked(meta.filter("session_id = 'a'")).count() == 1
    with pytest.raises(Exception, match="unknown schema_version 7"):
        sessions.versions_checked(meta).collect()


def test_entity_trees(spark, as_rows):
    paths = spark.createDataFrame([(p,) for p in ("A/1/x", "A/2/s/y", "A/.tmp/z", ".git/1/x", "B/1", "B/3/x", "A/1/w")], "path string")
    found = trees.entities(paths, ("e", "v"))
    assert as_rows(found) == [("A", "1"), ("A", "2"), ("B", "3")]
    assert as_rows(trees.list_entities(found, ("e", "v"), e="A", v=None)) == [("A", "1", 2), ("A", "2", 2)]
    assert as_rows(trees.list_versions(found, ("e", "v"), e="A")) == [("1",), ("2",)] and trees.list_versions(found, ("e", "v"), e="Z").count() == 0
    for bad in ({"e": ""}, {"x": "A"}, {"e": "a/b"}):
        with pytest.raises(ValueError):
            trees.list_entities(found, ("e", "v"), **bad)
    with pytest.raises(ValueError):
        trees.list_versions(found, ("e", "v"))
    files = paths.withColumn("content", F.concat(F.lit("in "), "path"))
    assert as_rows(trees.get_section(files, ("e", "v"), "s/y", e="A", v="2")) == [("s/y", "A/2/s/y", "in A/2/s/y", 10)]
    for name in ("../x", "/x", ""):
        with pytest.raises(ValueError):
            trees.get_section(files, ("e", "v"), name, e="A", v="2")


def test_several_roots(spark, as_rows):
    make = lambda *ps: spark.createDataFrame([(p, f"line\nfind me {p}") for p in ps], "path string, content string")
    roots = {"b": make("x.md", "sub/y.py", ".hidden/z.md", "n.bin"), "a": make("x.md")}
    assert as_rows(trees.fs_grep(roots, "find"), "path") == [("a/x.md",), ("b/sub/y.py",), ("b/x.md",)]
    assert [r.path for r in trees.fs_grep(roots, "find", cap=2).collect()] == ["b/sub/y.py", "b/x.md"]
    assert as_rows(trees.fs_grep(roots, "FIND", path="b/sub", ignore_case=True), "path", "line_no", "truncated") == [("b/sub/y.py", 2, False)]
    assert as_rows(trees.fs_grep(roots, "find", endings=["bin"]), "path") == [("b/n.bin",)] and trees.fs_grep(roots, "find", hidden=True).count() == 4
    assert as_rows(trees.fs_grep({"": roots["a"]}, "find"), "path") == [("x.md",)]
    for path in ("c/x", "b/../../x", "/b"):
        with pytest.raises(ValueError):
            trees.fs_grep(roots, "find", path=path)
    with pytest.raises(ValueError):
        trees.rooted({})


def test_no_shared_folder_is_an_error_on_a_cluster(spark, monkeypatch):
    from spindrift import runtime

    class Elsewhere:
        class conf:
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Elsewhere)


def test_workspaces_leave_nothing(tmp_path):
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "file://{tmp_path}/shared").config("spark.ui.enabled", "false").getOrCreate()
from spindrift.runtime import Workspace
d, _ = Workspace(s, "mine").keep(s.range(3))
assert d.count() == 3
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(__import__("pathlib").Path(__file__).parent.parent), capture_output=True)
    assert not list((tmp_path / "shared").glob("mine-*"))
