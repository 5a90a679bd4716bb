"""Entity trees and file roots as rows of paths: walks, listings, lookups, search over several roots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.files import FS_GREP_CAP, FS_TEXT, LIST_CAP, escapes, ignored, listed, matching_lines, suffix


def entities(paths: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The folders just len(keys) levels below the root of paths(path), by their names; ones below a folder that begins with a point are left out."""
    parts = F.split("path", "/")
    deep = paths.filter(F.size(parts) > len(keys)).select(F.slice(parts, 1, len(keys)).alias("p"))
    shown = deep.filter(~F.exists("p", lambda x: x.startswith(".") | (x == "")))
    return shown.select(*(F.col("p")[i].alias(k) for i, k in enumerate(keys))).distinct()


def _checked(keys: tuple[str, ...], ids: dict[str, str | None], needed: tuple[str, ...] = ()) -> dict[str, str]:
    unknown, lacking = set(ids) - set(keys), [k for k in needed if not ids.get(k)]
    if unknown or lacking:
        raise ValueError(f"identifiers: unknown {sorted(unknown)}, missing {lacking}")
    given = {k: v for k, v in ids.items() if v is not None}
    for k, v in given.items():
        if not isinstance(v, str) or not v or "/" in v or "\\" in v:
            raise ValueError(f"identifier {k}={v!r} must be a name without separators")
    return given


def _where(rows: DataFrame, ids: dict[str, str]) -> DataFrame:
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == kv[1]), ids.items(), rows)


def list_entities(found: DataFrame, keys: tuple[str, ...], **filters: str | None) -> DataFrame:
    """Entities whose identifiers are the ones given, in order, each row with the `count` of all. A filter that is no key, or empty, is an error; null filters hold for all."""
    rows = _where(found.select(*keys), _checked(keys, filters))
    return rows.join(F.broadcast(rows.agg(F.count("*").alias("count")))).orderBy(*keys)  # one row


def list_versions(found: DataFrame, keys: tuple[str, ...], **prefix: str) -> DataFrame:
    """Names on the last level below the others, which must all be given, in order. A prefix that is not there has none."""
    rows = _where(found, _checked(keys[:-1], prefix, keys[:-1]))
    return rows.select(keys[-1]).distinct().orderBy(keys[-1])


def get_section(files: DataFrame, keys: tuple[str, ...], section: str, **ids: str) -> DataFrame:
    """(section, path, content, size) of one section file of an entity among files(path, content); no row where it is not there. Names that leave the entity are errors."""
    if not section or section.startswith("/") or ".." in section.split("/"):
        raise ValueError(f"section {section!r} must be a relative name")
    given = _checked(keys, ids, keys)
    path = "/".join([*(given[k] for k in keys), section])
    return files.filter(F.col("path") == path).select(F.lit(section).alias("section"), "path", "content", F.length("content").alias("size"))


def display(root: Column, path: Column) -> Column:
    """A path as the user of several roots sees it: under the root's name, if it has one."""
    return F.when(root == "", path).when(path.isin("", "."), root).otherwise(F.concat_ws("/", root, path))


def rooted(roots: dict[str, DataFrame]) -> DataFrame:
    """The files of all roots as one tree: root, rank (of the root), path within it and `shown`. A single root may be nameless."""
    if not roots or ("" in roots and len(roots) > 1) or any("/" in name for name in roots):
        raise ValueError("roots need names without separators")
    each = [d.withColumn("root", F.lit(name)).withColumn("rank", F.lit(i)).withColumn("shown", display(F.lit(name), F.col("path"))) for i, (name, d) in enumerate(roots.items())]
    return reduce(lambda a, b: a.unionByName(b), each)


def located(roots: dict[str, DataFrame], path: str) -> tuple[str, str]:
    """Root and path within it of a path as shown; unknown roots and paths that leave their root are errors."""
    if not path or path.startswith(("/", "\\")):
        raise ValueError(f"path must be relative: {path!r}")
    root, rest = ("", path) if "" in roots else (path.split("/", 1)[0], path.partition("/")[2])
    if root not in roots:
        raise ValueError(f"no root {root!r}; there are {', '.join(sorted(roots))}")
    depth = 0
    for part in rest.split("/"):
        depth += {"": 0, ".": 0, "..": -1}.get(part, 1)
        if depth < 0:
            raise ValueError(f"{path!r} leaves its root")
    return root, rest


def fs_grep(roots: dict[str, DataFrame], needle: str, path: str | None = None, endings: list[str] | None = None, ignore_case: bool = False, hidden: bool = False, cap: int = FS_GREP_CAP) -> DataFrame:
    """The first `cap` lines with the text, root by root and path by path, of text files below `path`, or of all roots: (path as shown, line_no, line, truncated).

    Hidden and ignored folders are skipped unless `hidden`; endings are taken with or without their point.
    """
    tree = rooted(roots).filter(~ignored(F.col("path"), hidden) & ~escapes(F.col("path")))
    if path is not None:
        root, rest = located(roots, path)
        tree = tree.filter((F.col("root") == root) & (F.lit(rest in ("", ".")) | (F.col("path") == rest) | F.startswith(F.col("path"), F.lit(rest.rstrip("/") + "/"))))
    wanted = [f".{e.lower().lstrip('.')}" for e in endings] if endings else FS_TEXT
    texts = tree.filter(suffix(F.col("path")).isin(wanted))
    keyed = texts.select(F.to_json(F.struct("rank", "path", "shown")).alias("path"), "content")
    at = F.from_json("path", "rank int, path string, shown string")
    hits = matching_lines(keyed, needle, ignore_case).withColumn("at", at)
    first = hits.orderBy("at.rank", "at.path", "line_no").limit(cap)
    every = Window.partitionBy(F.lit(1))  # of at most `cap` rows
    return first.select(F.col("at.shown").alias("path"), "line_no", "line", (F.count("*").over(every) >= cap).alias("truncated"))


def fs_ls(roots: dict[str, DataFrame], path: str | None = None) -> DataFrame:
    """What lies right below a folder of the tree: name, type and size. Without a path the roots themselves, or what lies in a nameless one."""
    if path is None and "" not in roots:
        spark = next(iter(roots.values())).sparkSession
        return spark.createDataFrame([(name, "dir", None) for name in sorted(roots)][:LIST_CAP], "name string, type string, size bigint")
    root, rest = located(roots, path) if path else ("", "")
    return listed(roots[root].select("path", "size"), "" if rest in ("", ".") else rest)
