"""Files, session logs, sidecars and case lists as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.decoding import decoded
from spindrift.functions.markup import pdf_shown, shown
from spindrift.functions.text import LINE_END, stripped
from spindrift.operators.files import suffix
from spindrift.operators.ingestion import LOADERS, routed, routes
from spindrift.operators.sessions import TYPES
from spindrift.storage import Place

EVENT_SCHEMA = (
    "type string, seq int, session_id string, turn int, ts timestamp, query string, message string, name string, args string, call_id string, result string, truncated boolean, cached boolean,"
    " source string, locator string, value string, question string, candidates string, text string, metadata string, error string, recoverable boolean, level int, tokens_freed bigint,"
    " reason string, from_model string, to_model string, mode string"
)
ENTRY_SCHEMA = "id string, identifiers map<string,string>, text string, sections map<string,string>, source string"

# Content types by loader.
_TYPES = {"pdf": "application/pdf", "html": "text/html", "markdown": "text/markdown", "json": "application/json", "text": "text/plain"}


def discover(spark: SparkSession, root: str, loaders: dict[str, tuple[str, ...]] = LOADERS) -> DataFrame:
    """(source, size_bytes, raw) of a file, or of the files below a folder whose ending a loader takes, in no order. A missing root, or one that is neither, is an error.

    The bytes of files that no loader takes are not read: their paths are filtered first.
    """
    at = Place(spark, root)
    if not at.exists():
        raise FileNotFoundError(root)
    if not at.is_dir() and not at.is_file():
        raise NotADirectoryError(root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(at))
    found = found.select(F.regexp_replace("path", "^file:/*", "/").alias("source"), F.col("length").alias("size_bytes"), F.col("content").alias("raw"))
    return found if at.is_file() else found.filter(suffix(F.col("source")).isin(sorted(routes(loaders))))


def sources(spark: SparkSession, root: str, loaders: dict[str, tuple[str, ...]] = LOADERS) -> DataFrame:
    """(source, size_bytes) of what discover() finds, in order of their paths; the bytes are not read."""
    return discover(spark, root, loaders).select("source", "size_bytes").orderBy("source")


def load(spark: SparkSession, root: str, extra: Callable[[Column], dict[str, Column]] | None = None, loaders: dict[str, tuple[str, ...]] = LOADERS) -> DataFrame:
    """Loaded documents: raw bytes and metadata; line_count is of JSONL files only. What `extra` makes of the source wins over the loader's metadata."""
    rows = routed(discover(spark, root, loaders), loaders=loaders)
    lines = F.split(decoded(F.col("raw"), F.lit(None).cast("string")), LINE_END)
    rows = rows.select(
        "source", F.element_at(F.split("source", "/"), -1).alias("filename"), "size_bytes", F.col("loader").alias("format"), "raw",
        F.coalesce(*(F.when(F.col("loader") == k, v) for k, v in _TYPES.items())).alias("content_type"),
        F.when(suffix(F.col("source")) == ".jsonl", F.size(F.filter(lines, lambda x: stripped(x) != "")).cast("long")).alias("line_count"),
    )
    return rows.withColumns(extra(F.col("source"))) if extra else rows


def front_matter(text: Column) -> Column:
    """The lines between a first line `---` and the next line that is just that, or null; the text itself keeps them."""
    pattern = r"\A[ \t]*---[ \t]*(?:\r\n|\n|\r)((?:(?!---(?:\r\n|\n|\r|\z))[^\r\n]*(?:\r\n|\n|\r))*+)---(?:\r\n|\n|\r|\z)"
    block = F.regexp_replace(F.regexp_extract(text, pattern, 1), r"(?:\r\n|\n|\r)\z", "")
    return F.when(text.rlike(pattern) & (block != ""), block)


def front_matter_json(text: Column) -> Column:
    """The front matter as JSON text; null where there is none, where it is no YAML, and where it is no mapping. Needs PyYAML on the workers."""

    @F.pandas_udf("string")
    def parsed(blocks: pd.Series) -> pd.Series:
        import yaml

        def one(block: str | None) -> str | None:
            if block is None:
                return None
            try:
                value = yaml.safe_load(block)
            except yaml.YAMLError:
                return None
            return json.dumps(value, default=str, ensure_ascii=False) if isinstance(value, dict) else None

        return blocks.map(one, na_action=None)

    return parsed(front_matter(text))


def texts_of(rows: DataFrame) -> DataFrame:
    """Loaded documents with `text`: PDFs as their pages show it, markup as a page shows it, all else decoded; and with `frontmatter`, the JSON of a markdown file's."""
    plain = decoded(F.col("raw"), F.lit(None).cast("string"))
    text = F.when(F.col("format") == "pdf", pdf_shown(F.col("raw"))).when(F.col("format") == "html", shown(plain)).otherwise(plain)
    rows = rows.withColumn("text", text)
    return rows.withColumn("frontmatter", F.when(F.col("format") == "markdown", front_matter_json(F.col("text"))))


def session_logs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events of JSONL session logs with the wide schema, and the lines that are none: unreadable, or of an unknown type. Blank lines are skipped."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    e = F.from_json("value", EVENT_SCHEMA)
    rows = raw.select("value", e.alias("e"))
    known = F.coalesce(F.col("e.type").isin(TYPES), F.lit(False))
    return rows.filter(known).select("e.*"), rows.filter(~known).select("value", F.col("e.type").alias("type"))


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Search entries of a sidecar: a JSON list of objects. A missing file, bad JSON or no list gives none; entries without an id are left out."""
    if not Place(spark, path).exists():
        return spark.createDataFrame([], ENTRY_SCHEMA)
    whole = spark.read.text(path, wholetext=True)
    each = F.explode(F.from_json("value", f"array<struct<{ENTRY_SCHEMA.replace(' string', ':string').replace(' map', ':map')}>>"))
    return whole.select(each.alias("e")).filter("e.id is not null").select("e.*")


def cases_file(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a YAML file."""
    import yaml

    return cases(spark, yaml.safe_load(Place(spark, path).read().decode()))


def event_lines(events: DataFrame) -> DataFrame:
    """Events as JSON lines (session_id, seq, line), the other way round from session_logs(): fields that an event lacks are left out, times are ISO and UTC."""
    known = [c.split()[0] for c in EVENT_SCHEMA.split(", ") if c.split()[0] in events.columns]
    return events.select("session_id", "seq", F.to_json(F.struct(*known), {"ignoreNullFields": "true", "timeZone": "UTC"}).alias("line"))


def frames(events: DataFrame) -> DataFrame:
    """Events as a server sends them, (session_id, seq, frame): a line with the type, a line with the event. Events without a type are none."""
    lines = event_lines(events.filter("type is not null"))
    kind = F.get_json_object("line", "$.type")
    return lines.select("session_id", "seq", F.concat(F.lit("event: "), kind, F.lit("\ndata: "), "line").alias("frame"))


_CASE_KEYS = {"id", "query", "expected_citations", "forbidden_phrases", "expected_clarification", "max_tokens", "max_seconds"}


def cases(spark: SparkSession, items: Any) -> DataFrame:
    """Evaluation cases of a parsed list, or of a mapping with `cases`. Unknown keys, missing ids or queries and budgets that are not positive are errors."""
    items = items.get("cases") if isinstance(items, dict) else items
    if not isinstance(items, list):
        raise ValueError("cases must be a list")
    out = []
    for c in items:
        if not isinstance(c, dict) or not c.get("id") or not c.get("query") or set(c) - _CASE_KEYS:
            raise ValueError(f"bad case: {c!r}")
        if not isinstance(c.get("expected_clarification"), (bool, type(None))):
            raise ValueError(f"{c['id']}: expected_clarification must be true or false")
        for k in ("max_tokens", "max_seconds"):
            if c.get(k) is not None and (isinstance(c[k], bool) or c[k] <= 0):
                raise ValueError(f"{c['id']}: {k} must be positive")
        seconds = c.get("max_seconds")
        out.append((c["id"], c["query"], c.get("expected_citations") or [], c.get("forbidden_phrases") or [], c.get("expected_clarification"), c.get("max_tokens"), float(seconds) if seconds else None))
    schema = "case_id string, query string, expected_citations array<string>, forbidden_phrases array<string>, expected_clarification boolean, max_tokens int, max_seconds double"
    return spark.createDataFrame(out, schema)
