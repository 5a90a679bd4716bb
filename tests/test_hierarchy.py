import random

import pytest

from spindrift.operators.hierarchy import current_rows, descendants, hierarchies, intervals, known_links
from spindrift.runtime import hub_join


def brute(parents):
    """(root, depth) of every node by walking up."""
    out = {}
    for n in parents:
        seen, at = [], n
        while parents.get(at) in parents and at not in seen:
            seen.append(at)
            at = parents[at]
        if at in seen:
            ring, x = [at], parents[at]
            while x != at:
                ring.append(x)
                x = parents[x]
            out[n] = (min(ring), -1)
        else:
            out[n] = (at, len(seen))
    return out


def links(spark, parents):
    return known_links(spark.createDataFrame([(k, v) for k, v in parents.items()], "id string, parent string"))


@pytest.mark.parametrize("seed, local", [(1, 100), (2, 100), (2, 3), (3, 0)])
def test_forests_with_cycles_against_walking_up(spark, seed, local):
    rnd = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(60)]
    parents = {n: rnd.choice([None, "gone", *ids]) if rnd.random() < 0.5 else ids[(i * 7 + 1) % 60] if rnd.random() < 0.9 else None for i, n in enumerate(ids)}
    want = brute(parents)
    table = hierarchies(links(spark, parents), local_nodes=local)
    nodes = table.collect()
    assert {r.id: (r.root, r.depth) for r in nodes} == want and {r.id: r.parent for r in nodes} == {n: p if p in parents else None for n, p in parents.items()}
    below = {n: 0 for n in parents}
    for n in parents:
        at = n
        while want[n][1] >= 0 and at in parents:
            below[at] += 1
            at = parents[at]
    for r in nodes:
        if r.depth >= 0:
            assert r.subtree == below[r.id] and len(r.path) == r.depth + 1 and r.path[-1] == r.id
    pairs = {(r.ancestor, r.descendant) for r in descendants(table).collect()}
    held = intervals(table).collect()
    assert {(a.id, b.id) for a in held for b in held if a.first < b.first <= a.last} == pairs


def test_chain_fan_self_parent_and_orphan(spark):
    parents = {f"c{i:02d}": f"c{i - 1:02d}" if i else None for i in range(25)}
    parents |= {f"f{i}": "c03" for i in range(8)} | {"self": "self", "below": "self", "orphan": "nobody", "a": "b", "b": "a"}
    nodes = {r.id: r for r in hierarchies(links(spark, parents)).collect()}
    assert {k: (r.root, r.depth) for k, r in nodes.items()} == brute(parents)
    assert nodes["c24"].path == [f"c{i:02d}" for i in range(25)]
    assert nodes["c00"].subtree == 33 and nodes["c03"].subtree == 30 and nodes["f1"].subtree == 1
    assert nodes["self"].cyclic and nodes["below"].path is None and nodes["a"].subtree is None
    assert nodes["orphan"].depth == 0 and nodes["orphan"].path == ["orphan"]


def test_descendants_are_rows(spark, as_rows):
    got = as_rows(descendants(hierarchies(links(spark, {"a": None, "b": "a", "c": "b", "x": "y", "y": "x"}))))
    assert got == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


def test_empty_table(spark):
    assert hierarchies(spark.createDataFrame([], "id string, parent string")).count() == 0


def test_current_row_of_a_session(spark, as_rows):
    schema = "session_id string, parent_id string, last_updated string, event_count int, schema_version int, id string"
    data = [
        (" s1 ", "old", "2026-01-01T10:00:00+02:00", 1, 2, "x"),
        ("s1", " p ", "2026-01-01T09:00:00Z", 1, 2, "x"),  # the later instant
        ("s2", "  ", "2026-01-01T09:00:00Z", 1, 2, "x"),
        ("s2", "  ", "2026-01-01T09:00:00Z", 1, 2, "x"),
        ("s3", "p", None, None, None, None),
        ("s3", "q", "no date", 1, 1, "x"),
        (None, "p", "2026-01-01T09:00:00Z", 1, 2, "x"),
        ("  ", "p", "2026-01-01T09:00:00Z", 1, 2, "x"),
    ]
    got = as_rows(current_rows(spark.createDataFrame(data, schema)))
    assert got == [("s1", "p"), ("s2", None), ("s3", "q")]


def test_hubs_and_nulls_in_joins(spark, as_rows):
    rows = spark.createDataFrame([(i, "hub" if i < 50 else "gone" if i < 60 else None if i < 70 else f"k{i}") for i in range(90)], "id long, key string")
    right = spark.createDataFrame([(k, k.upper()) for k in ("hub", *(f"k{i}" for i in range(70, 85)))], "key string, v string")
    for how in ("inner", "left"):
        assert as_rows(hub_join(rows, right, "key", how, hub_rows=8), "id", "v") == as_rows(rows.join(right, "key", how), "id", "v")


def test_long_chain_and_wide_fan_by_rounds(spark):
    parents = {f"c{i:03d}": f"c{i - 1:03d}" if i else None for i in range(150)} | {f"f{i:03d}": "c149" for i in range(150)}
    nodes = {r.id: r for r in hierarchies(links(spark, parents), local_nodes=20).collect()}
    assert {k: (r.root, r.depth) for k, r in nodes.items()} == brute(parents)
    assert nodes["c000"].subtree == 300 and nodes["f000"].path == [f"c{i:03d}" for i in range(150)] + ["f000"]
