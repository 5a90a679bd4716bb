"""Files and artifacts as rows (path, content): line search, reads, listings, globbing, sandbox rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import folded, lines

# File name endings taken for text, and directories never looked into.
FS_TEXT = (
    ".c .cfg .cpp .css .csv .env .go .h .hpp .html .ini .java .js .json .jsonl .jsx .kt .lua .md .php .pl .py .rb .rs"
    " .scss .sh .sql .svelte .swift .toml .ts .tsv .tsx .txt .vue .xml .yaml .yml .zsh"
).split()
ARTIFACT_TEXT = ".csv .json .jsonl .md .txt .tsv .yaml .yml".split()
IGNORED = ".git .hg .mypy_cache .pytest_cache .ruff_cache .svn .tox .venv __pycache__ node_modules venv".split()
GREP_CAP, FS_GREP_CAP, LIST_CAP, FS_READ_MAX = 10, 20, 200, 8000


def suffix(path: Column) -> Column:
    """The ending of a file name with its point, in lower case, or an empty text; a leading point begins no ending."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^.](\.[^.]+)$", 1))


def is_text(path: Column, artifact: bool) -> Column:
    """Whether a file is read as text: artifacts without an ending are, files of a tree are not."""
    return suffix(path).isin(["", *ARTIFACT_TEXT] if artifact else FS_TEXT)


def ignored(path: Column, hidden: bool = False) -> Column:
    bad = lambda p: p.isin(*IGNORED) | (F.lit(not hidden) & p.startswith(".") & ~p.isin(".", ".."))
    return F.exists(F.split(path, "/"), bad)


def escapes(path: Column) -> Column:
    """Whether a path is refused: empty, absolute, or leaving its root at any point."""
    depth = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda a, p: F.struct(
            (a["d"] + F.when(p.isin("", "."), 0).when(p == "..", -1).otherwise(1)).alias("d"),
            F.least(a["low"], a["d"] + F.when(p == "..", -1).otherwise(0)).alias("low"),
        ),
        lambda a: a["low"],
    )
    return (path == "") | path.startswith("/") | (depth < 0)


def glob_regex(pattern: str) -> str:
    """A glob over paths as a regular expression: ** any directories, * and ? within one name, [..] classes."""
    if not pattern or pattern.startswith("/"):
        raise ValueError("pattern must be relative")
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "[" and "]" in pattern[i + 2 :]:
            j = pattern.index("]", i + 2)
            body = pattern[i + 1 : j]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", j + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return f"^{out}$"


def matching_lines(files: DataFrame, needle: str, ignore_case: bool = False) -> DataFrame:
    """(path, line_no from 1, line) of every line with the literal text. Files without it are not taken apart."""
    if not needle:
        raise ValueError("empty search text")
    fold = folded if ignore_case else lambda c: c
    want = fold(F.lit(needle))
    hit = files.filter(F.contains(fold(F.col("content")), want)).select("path", F.posexplode(lines(F.col("content"))).alias("no", "line"))
    return hit.filter(F.contains(fold(F.col("line")), want)).select("path", (F.col("no") + 1).alias("line_no"), "line")


def grep(files: DataFrame, needle: str, ignore_case: bool = False, cap: int = GREP_CAP) -> DataFrame:
    """The first `cap` matching lines in order of path and line; `truncated` holds if there are as many as that."""
    first = matching_lines(files, needle, ignore_case).orderBy("path", "line_no").limit(cap)
    return first.withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(1))) >= cap)  # of at most `cap` rows


def grep_per_file(files: DataFrame, needle: str, cap: int = GREP_CAP) -> DataFrame:
    """For each file: its matches, how many are shown and whether the cap is reached."""
    n = matching_lines(files, needle).groupBy("path").agg(F.count("*").alias("matches"))
    return n.select("path", "matches", F.least("matches", F.lit(cap)).alias("shown"), (F.col("matches") >= cap).alias("truncated"))


def read_slice(files: DataFrame, offset: int = 0, limit: int = 4000, maximum: int | None = None) -> DataFrame:
    """(path, content, offset, limit, has_more, total_size) of a part of each text."""
    if offset < 0 or limit <= 0:
        raise ValueError("offset must not be negative and limit must be positive")
    limit = min(limit, maximum) if maximum else limit
    size = F.length("content")
    return files.select("path", F.substring("content", offset + 1, limit).alias("content"), F.lit(offset).alias("offset"), F.lit(limit).alias("limit"), (F.lit(offset + limit) < size).alias("has_more"), size.alias("total_size"))


def listed(paths: DataFrame, base: str = "") -> DataFrame:
    """The entries right below a directory: name, type and size (null for directories), sorted by name, LIST_CAP at most."""
    prefix = f"{base.rstrip('/')}/" if base else ""
    rest = F.substring("path", len(prefix) + 1, 1_000_000)
    here = paths.filter(F.col("path").startswith(prefix) & ~ignored(rest)).withColumn("rest", rest)
    name = F.substring_index("rest", "/", 1)
    out = here.groupBy(name.alias("name")).agg(F.max(F.contains(F.col("rest"), F.lit("/"))).alias("dir"), F.max("size").alias("size"))
    return out.select("name", F.when(F.col("dir"), "dir").otherwise("file").alias("type"), F.when(~F.col("dir"), F.col("size")).alias("size")).orderBy("name").limit(LIST_CAP)


def json_fields(rows: DataFrame, payload: str, fields: list[str]) -> DataFrame:
    """Top-level fields of JSON objects: values as JSON text, available keys (sorted), missing keys (in order of request). Payloads that are no object give nulls."""
    keys = F.array_sort(F.json_object_keys(payload))
    values = {f: F.get_json_object(payload, f"$.{f}") for f in fields}
    missing = F.filter(F.array(*(F.lit(f) for f in fields)), lambda f: ~F.array_contains(keys, f))
    return rows.withColumns({f"field_{f}": v for f, v in values.items()} | {"available_keys": F.array_join(keys, ","), "missing_keys": F.array_join(missing, ",")})
