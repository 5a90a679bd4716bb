"""Parent-child links to full hierarchies, by leaf peeling.

Every round peels the leaves, which hand their subtree size to their parent, and then takes an independent set of the
nodes left with a single child out of their chains, so that a chain of n links needs about log n rounds instead of n.
What outlives the rounds, once it is few enough for one task, is peeled there leaf by leaf. Going back in the order of
peeling, each node taken away finds its target among the nodes that outlived it and gets root, depth and path from it.
A node that only ever points at itself after the peeling closes a cycle.

No step gathers a family: what a parent gets from its children is a sum, formed before the shuffle. The list of a node's
descendants is the interval that intervals() gives it, and descendants() makes rows of it. Joins in which many children
ask for one parent answer the few parents with very many from a broadcast of bounded size (hub_join).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.runtime import Workspace, hub_join, trimmed

MAX_ROUNDS = 200
#: Nodes that one task peels to the end; more are first brought down to so many by distributed rounds.
LOCAL_NODES = 100_000
#: Ids in the paths of one batch of results.
BATCH_IDS = 500_000


def current_rows(meta: DataFrame) -> DataFrame:
    """(id, parent) of each session's current row.

    Ids and parents are trimmed, a blank parent is none, rows with a null or blank id are left out. Current is the row
    with the latest last_updated instant (unreadable or null ones count as oldest); among ties the one with the
    greatest schema_version, event_count and parent, so that repeats and ties give one defined row.
    """
    parent = trimmed(F.col("parent_id"))
    at = F.coalesce(F.expr("try_cast(last_updated as timestamp)"), F.lit("0001-01-01").cast("timestamp"))
    rank = F.struct(at, F.coalesce("schema_version", F.lit(-1)), F.coalesce("event_count", F.lit(-1)), F.coalesce(parent, F.lit("")))
    rows = meta.select(trimmed(F.col("session_id")).alias("id"), F.when(parent != "", parent).alias("parent"), rank.alias("rank"))
    return rows.filter("id != ''").groupBy("id").agg(F.max_by("parent", "rank").alias("parent"))


def known_links(nodes: DataFrame) -> DataFrame:
    """nodes(id, parent) with parents that are no node of the table set to null. Nodes without a parent take no part in the join."""
    ids = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    asked = hub_join(nodes.filter("parent is not null").select("id", "parent"), ids, "parent", "left")
    return asked.select("id", F.when(F.col("there"), F.col("parent")).alias("parent")).unionByName(nodes.filter("parent is null").select("id", "parent"))


def _priority(c: Column, k: int) -> Column:
    return F.struct(F.xxhash64(c, F.lit(k)), c)


_STATE = "id string, link string, parent string, w int, acc long, carry long, cycle string, lo string, seg array<string>"
_NODE = "id string, parent string, root string, depth int, subtree long, path array<string>"


def _peeled(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rest of a peeling in one task: rows of _STATE to rows of _NODE."""
    rows = {r.id: r for r in frame.itertuples(index=False)}
    parent = {k: r.parent for k, r in rows.items() if isinstance(r.parent, str)}
    size = {k: int(r.acc) for k, r in rows.items()}
    kids = dict.fromkeys(rows, 0)
    for p in parent.values():
        kids[p] += 1
    leaves, order = deque(k for k, n in kids.items() if not n), []
    while leaves:
        leaf = leaves.popleft()
        order.append(leaf)
        if (up := parent.get(leaf)) is not None:
            size[up] += size[leaf] + int(rows[leaf].carry)
            kids[up] -= 1
            if not kids[up]:
                leaves.append(up)
    ring: dict[str, str] = {}  # what was never a leaf, to the smallest id on its cycle
    for k in rows.keys() - set(order):
        if k not in ring:
            round_, at = [], k
            while not round_ or at != k:
                round_.append(at)
                at = parent[at]
            least = min(x for n in round_ for x in (n, rows[n].lo) if isinstance(x, str))
            ring |= dict.fromkeys(round_, least)
    found: dict[str, tuple[str, int]] = {k: (least, -1) for k, least in ring.items()}
    for k in reversed(order):
        up, r = parent.get(k), rows[k]
        if up is None:
            found[k] = (r.cycle, -1) if isinstance(r.cycle, str) else (k, 0)
        else:
            root, depth = found[up]
            found[k] = (root, depth + int(r.w) if depth >= 0 else -1)
    out, held = [], 0
    for k, (root, depth) in found.items():
        path = None
        if depth >= 0:
            steps, at = [k], k
            while (up := parent.get(at)) is not None:
                steps += [*reversed(rows[at].seg), up]
                at = up
            path = steps[::-1]
        own = k in ring or isinstance(rows[k].cycle, str)
        out.append((k, rows[k].link if isinstance(rows[k].link, str) else None, root, depth, None if own else size[k], path))
        held += depth + 2
        if held > BATCH_IDS:
            yield pd.DataFrame(out, columns=_names(_NODE)).astype({"subtree": "Int64"})
            out, held = [], 0
    yield pd.DataFrame(out, columns=_names(_NODE)).astype({"subtree": "Int64"})


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _peel_here(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = [f for f in frames if len(f)]
    if held:
        yield from _peeled(pd.concat(held))


def _round(alive: DataFrame, k: int) -> DataFrame:
    """One distributed round: which nodes leave (as a leaf, or out of a chain), and what the others take over from them."""
    kids = alive.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    a1 = alive.join(kids, "id", "left").withColumn("leaf", F.col("kids").isNull() & F.col("parent").isNotNull()).drop("kids")
    stays = ~F.col("leaf")
    sums = a1.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(
        F.count_if(stays).alias("left"), F.max(F.when(stays, F.struct("id", "carry"))).alias("stay"), F.sum(F.when(F.col("leaf"), F.col("acc") + F.col("carry"))).alias("add")
    )
    me, kid, up = (_priority(F.col(c), k) for c in ("id", "kid", "parent"))
    out = stays & F.col("parent").isNotNull() & (F.col("left") == 1) & (F.col("kid") != F.col("id")) & (me < kid) & (me < up)
    a2 = (
        a1.join(sums, "id", "left")
        .withColumn("kid", F.col("stay.id"))
        .withColumn("between", F.col("stay.carry"))
        .withColumn("acc", F.col("acc") + F.coalesce("add", F.lit(0)))
        .withColumn("out", F.coalesce(out, F.lit(False)))
        .drop("left", "add", "stay")
    )
    note = a2.filter("out").select(
        F.col("kid").alias("id"), F.col("parent").alias("np"), F.col("w").alias("nw"), (F.col("acc") + F.col("carry")).alias("nc"),
        F.least("lo", "id").alias("nlo"), F.concat("seg", F.array("id")).alias("nseg"),
    )
    got = F.col("np").isNotNull()
    return (
        a2.join(note, "id", "left")
        .withColumn("parent", F.when(got, F.col("np")).otherwise(F.col("parent")))
        .withColumn("w", F.when(got, F.col("w") + F.col("nw")).otherwise(F.col("w")))
        .withColumn("carry", F.when(got, F.col("carry") + F.col("nc")).otherwise(F.col("carry")))
        .withColumn("lo", F.when(got, F.least("lo", "nlo")).otherwise(F.col("lo")))
        .withColumn("seg", F.when(got, F.concat("nseg", "seg")).otherwise(F.col("seg")))
        .withColumn("cycle", F.when(F.col("parent") == F.col("id"), F.least("lo", "id")).otherwise(F.col("cycle")))
        .withColumn("parent", F.when(F.col("parent") != F.col("id"), F.col("parent")))
        .drop("np", "nw", "nc", "nlo", "nseg")
    )


def hierarchies(links: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """links(id, parent), unique ids, parent null or an id: one row per node.

    Returns id, parent, root, depth, subtree (nodes below it, itself included; null on a cycle), cyclic and path (ids from
    the root to the node; null where the links run into a cycle). On a cycle or below one, root is the smallest id on the
    cycle and depth is -1. An empty table gives an empty result. Nodes with null ids are left out; a node that is its own
    parent is a cycle of one.
    """
    ws = Workspace(links.sparkSession, "hierarchy")
    parent, none = F.col("parent"), F.lit(None).cast("string")
    start = links.filter("id is not null").select(
        "id", parent.alias("link"), F.when(parent != F.col("id"), parent).alias("parent"), F.lit(1).cast("int").alias("w"), F.lit(1).cast("long").alias("acc"), F.lit(0).cast("long").alias("carry"),
        F.when(parent == F.col("id"), F.col("id")).alias("cycle"), none.alias("lo"), F.array().cast("array<string>").alias("seg"),
    )
    columns = start.columns
    alive, _ = ws.keep(start)
    rounds = []
    while alive.count() > local_nodes:
        if not alive.filter("parent is not null").take(1):
            break
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError("leaf peeling did not end")
        step, _ = ws.keep(_round(alive, len(rounds)))
        rounds.append(step)
        alive = step.filter("not leaf and not out").select(columns)

    if alive.count() <= local_nodes:
        done = alive.coalesce(1).mapInPandas(_peel_here, _NODE)
    else:  # roots and closed cycles alone
        path = F.when(F.col("cycle").isNull(), F.array("id"))
        whole = F.col("cycle").isNull()
        done = alive.select("id", F.col("link").alias("parent"), F.coalesce("cycle", "id").alias("root"), F.when(whole, 0).otherwise(-1).alias("depth"), F.when(whole, F.col("acc")).alias("subtree"), path.alias("path"))
    if rounds:
        parts = [ws.keep(done)[1]]
        for step in reversed(rounds):  # each adds its own nodes; those found before stay as they are
            for which in ("out", "leaf"):
                known = links.sparkSession.read.schema(done.schema).parquet(*parts)
                gone = step.filter(which)
                if which == "out":  # what its one child holds, which outlived it
                    gone = gone.join(known.select(F.col("id").alias("kid"), F.col("subtree").alias("below")), "kid", "left")
                    size = F.col("acc") + F.col("between") + F.col("below")
                else:
                    size = F.col("acc")
                up = known.select(F.col("id").alias("parent"), "root", F.col("depth").alias("d"), F.col("path").alias("p"))
                new = hub_join(gone, up, "parent").select(
                    "id", F.col("link").alias("parent"), "root", F.when(F.col("d") >= 0, F.col("d") + F.col("w")).otherwise(-1).cast("int").alias("depth"), size.alias("subtree"), F.concat("p", "seg", F.array("id")).alias("path")
                )
                parts.append(ws.keep(new)[1])
        done = links.sparkSession.read.schema(done.schema).parquet(*parts)
    else:
        done, _ = ws.keep(done)
    return done.select("id", "parent", "root", "depth", "subtree", (F.col("depth") < 0).alias("cyclic"), "path")


def intervals(nodes: DataFrame) -> DataFrame:
    """Nodes of hierarchies() outside cycles with `first` and `last`: the descendants of a node are just those whose first lies after its own, up to its last.

    The list of descendants in bounded form. Numbers are places in the order of paths, in which a node comes right
    before what is below it; rows are put in that order in parts, and numbered by the parts' sizes.
    """
    ws = Workspace(nodes.sparkSession, "intervals")
    rows = nodes.filter("depth >= 0").repartitionByRange("path").sortWithinPartitions("path")
    kept, _ = ws.keep(rows.select("id", "root", "depth", "subtree", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    sizes = {r._part: r.n for r in kept.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    before, total = [], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    starts = nodes.sparkSession.createDataFrame(before, "_part int, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))  # the lower bits count within the partition
    return kept.join(F.broadcast(starts), "_part").select("id", "root", "depth", place.alias("first"), (place + F.col("subtree") - 1).alias("last"))


def descendants(nodes: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) pairs of hierarchies(), as rows, as many as the depths add up to; nodes at or below a cycle have none."""
    steps = F.posexplode("path").alias("at", "ancestor")
    return nodes.filter("depth > 0").select(F.col("id").alias("descendant"), "depth", steps).filter("at < depth").select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def fork_forest(nodes: DataFrame) -> DataFrame:
    """nodes with `sibling`, the key that puts the children of a parent, and the roots, in order: created and then id. A key instead of a rank, as one parent may have a third of all rows as children."""
    return nodes.withColumn("sibling", F.concat_ws(" ", F.coalesce("created", F.lit("")), "id"))
