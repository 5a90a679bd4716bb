"""Corpus compilation as tables: routing, identities, validation as columns, idempotency, caches, reports, sidecars."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import stripped
from spindrift.operators.files import suffix

# Which loader takes which ending.
LOADERS = {"pdf": (".pdf",), "html": (".html", ".htm"), "markdown": (".md", ".markdown"), "json": (".json", ".jsonl"), "text": (".txt",)}


def routes(loaders: dict[str, tuple[str, ...]] = LOADERS) -> dict[str, str]:
    """Loader by ending in lower case; an ending claimed twice is an error."""
    out: dict[str, str] = {}
    for name, endings in loaders.items():
        for e in endings:
            if out.setdefault(e.lower(), name) != name:
                raise ValueError(f"{e} is claimed by {out[e.lower()]} and {name}")
    return out


def routed(sources: DataFrame, path: str = "source", loaders: dict[str, tuple[str, ...]] = LOADERS) -> DataFrame:
    """sources with `loader`, or null where none takes the ending."""
    table = F.create_map(*(F.lit(x) for kv in routes(loaders).items() for x in kv))
    return sources.withColumn("loader", F.try_element_at(table, suffix(F.col(path))))


def identity(source: Column) -> list[Column]:
    """Ticker and fiscal year of a source named .../TICKER/YYYY/name or ticker-YYYY.ext."""
    tree = r"([A-Za-z]+)/((?:19|20)\d\d)/[^/]+$"
    flat = r"(?:^|/)([a-z]+)-((?:19|20)\d\d)\.[a-z]+$"
    pick = lambda k: F.when(source.rlike(tree), F.regexp_extract(source, tree, k)).when(source.rlike(flat), F.regexp_extract(source, flat, k))
    return [F.upper(pick(1)).alias("ticker"), pick(2).alias("year")]


def identified(loads: DataFrame, identifiers: Callable[[Column], dict[str, Column]] | None = None, source_id: Callable[[Column], Column] | None = None) -> DataFrame:
    """Loads with `identifiers`, a map made from their source (by default ticker and year), and `source_id`, the name their dead letters go by (by default the file's name without its ending)."""
    source = F.col("source")
    named = identifiers(source) if identifiers else dict(zip(("ticker", "year"), identity(source)))
    stem = source_id(source) if source_id else F.regexp_extract(F.element_at(F.split(source, "/"), -1), r"^(.[^.]*(?:\.[^.]+)*?)(?:\.[^.]*)?$", 1)
    return loads.withColumns({"identifiers": F.create_map(*(x for k, c in named.items() for x in (F.lit(k), c))), "source_id": stem})


def section_specs(specs: DataFrame) -> DataFrame:
    glob = F.col("name").endswith("*")
    return specs.select("name", "required", "max_chars", glob.alias("glob"), F.when(glob, F.expr("substring(name, 1, length(name) - 1)")).otherwise(F.col("name")).alias("prefix"))


def resolved_sections(sections: DataFrame, specs: DataFrame) -> DataFrame:
    """(section, spec): the spec of each distinct section, by name, else by the longest prefix before a `*`, or null."""
    own = sections.select("section").filter("section is not null").distinct()
    cut = own.select("section", F.explode(F.transform(F.sequence(F.lit(0), F.length("section")), lambda i: F.substring("section", F.lit(1), i))).alias("prefix"))
    hits = cut.join(section_specs(specs), "prefix").filter("glob or prefix = section")
    best = hits.groupBy("section").agg(F.max_by("name", F.struct(~F.col("glob"), F.length("prefix"))).alias("spec"))
    return own.join(best, "section", "left")


def validated(docs: DataFrame, specs: DataFrame) -> DataFrame:
    """docs(doc_id, entity_id, version, section, text): with `errors`, what is wrong with each, joined by '; ' and empty where nothing is."""
    limits = resolved_sections(docs, specs).join(specs.select(F.col("name").alias("spec"), "max_chars"), "spec", "left")
    rows = docs.join(limits, "section", "left")
    bad_id = lambda c: F.col(c).isNull() | (F.col(c) == "") | F.col(c).rlike(r"[/\\]")
    checks = F.array(
        F.when(bad_id("entity_id"), "identifier entity_id"),
        F.when(bad_id("version"), "identifier version"),
        F.when(F.col("section").isNull(), "no section"),
        F.when(F.col("section").isNotNull() & F.col("spec").isNull(), "unknown section"),
        F.when(F.col("text").isNull(), "content is null"),
        F.when(F.length("text") > F.col("max_chars"), F.concat(F.lit("length "), F.length("text"), F.lit(" exceeds max_chars="), "max_chars")),
    )
    return rows.select("doc_id", "entity_id", "version", "section", "spec", F.array_join(checks, "; ").alias("errors"))


def missing_required(docs: DataFrame, specs: DataFrame) -> DataFrame:
    """(entity_id, version, section) of required sections an entity lacks.

    The specs of a schema are one row here, their names as an array, so that what is due of an entity is an explode of
    it; a schema is a file written by hand, whose names a row holds.
    """
    due = specs.filter("required and not endswith(name, '*')").agg(F.sort_array(F.collect_set("name")).alias("names"))
    entities = docs.select("entity_id", "version").filter("entity_id is not null").distinct()
    due = entities.join(F.broadcast(due)).select("entity_id", "version", F.explode("names").alias("section"))  # one row
    return due.join(docs.select("entity_id", "version", "section").distinct(), ["entity_id", "version", "section"], "left_anti")


def source_hash(raw: Column) -> Column:
    return F.sha2(raw, 256)


def cache_key(raw: Column, version: str, prompt: str) -> Column:
    """source:schema version:prompt, each by hash or name; equal keys need no new extraction."""
    return F.concat_ws(":", source_hash(raw), F.lit(version), F.sha2(F.lit(prompt).cast("binary"), 256))


def chunk_key(chunk: Column, prompt: str, version: str) -> Column:
    return F.sha2(F.concat_ws("\x00", chunk, F.lit(prompt), F.lit(version)).cast("binary"), 256)


def not_yet_extracted(loads: DataFrame, manifests: DataFrame, keys: list[str], key: str = "cache_key") -> DataFrame:
    """Loads whose identity and cache key no manifest has."""
    return loads.join(manifests.select(*keys, key).distinct(), [*keys, key], "left_anti")


def cache_probe(chunks: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """chunks with `hit`: whether the cache holds their key."""
    return chunks.join(cache.select(key, F.lit(True).alias("_in")).distinct(), key, "left").withColumn("hit", F.coalesce("_in", F.lit(False))).drop("_in")


def report(outcomes: DataFrame) -> DataFrame:
    """outcomes(status, tokens, and where there are some cost, started and ended): one row of counts, dollars and seconds from the first start to the last end."""
    n = lambda s: F.count_if(F.col("status") == s)
    cost = [F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost")] if "cost" in outcomes.columns else []
    seconds = [((F.unix_micros(F.max("ended")) - F.unix_micros(F.min("started"))) / 1e6).alias("seconds")] if {"started", "ended"} <= set(outcomes.columns) else []
    return outcomes.agg(n("succeeded").alias("succeeded"), n("failed").alias("failed"), n("skipped").alias("skipped"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), *cost, *seconds)


def sidecar_entries(docs: DataFrame) -> DataFrame:
    """Search entries: id (identifier values by sorted key joined by '/'), identifiers, text (sections in order, joined by blank lines), sections (name and text, in order) and source (the first that is not empty).

    An entry is one row by contract: an entity's texts must fit into one, of 2 GB at most.
    """
    named = docs.filter("entity_id is not null and version is not null and text is not null")
    part = F.struct(F.coalesce("section", F.lit("")).alias("name"), "doc_id", "text")
    rows = named.groupBy("entity_id", "version").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.min(F.when(F.col("source") != "", F.col("source"))).alias("source"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")
    sections = F.transform("parts", lambda p: F.struct(p["name"].alias("name"), p["text"].alias("text")))
    identifiers = F.create_map(F.lit("entity_id"), F.col("entity_id"), F.lit("version"), F.col("version"))
    return rows.select(F.concat_ws("/", "entity_id", "version").alias("id"), identifiers.alias("identifiers"), text.alias("text"), sections.alias("sections"), F.coalesce("source", F.lit("")).alias("source"))


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The new rows and the old ones whose key is not among them."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti").select(new.columns))


def ordered_fragments(rows: DataFrame, key: list[str], order: str, text: str) -> DataFrame:
    """The fragments of each key in order, stripped, blank ones dropped, joined by rules."""
    body = stripped(F.col(text))
    kept = rows.filter(body != "").withColumn("_t", body)
    parts = kept.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(order, "_t"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["_t"]), "\n\n---\n\n")
    return parts.select(*key, F.size("p").cast("long").alias("fragments"), joined.alias("joined"))


class Adapter(Protocol):
    """The model boundary: a text in, JSON text out. Must be serialisable and must give the same output for the same input, as tasks can be repeated."""

    def __call__(self, text: str) -> str: ...


def stub_adapter(text: str) -> str:
    """A deterministic stand-in for a model: the first line and the number of words."""
    import json

    return json.dumps({"summary": text.split("\n", 1)[0][:200], "words": len(text.split())})


def extracted(docs: DataFrame, adapter: Callable[[str], str] = stub_adapter, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, response, error): the adapter's output for each text; a failure is a row with an error, not an exception."""
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, t in zip(frame[key], frame[text]):
                try:
                    out.append((k, adapter(t), None))
                except Exception as e:  # noqa: BLE001
                    out.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "response", "error"])

    return docs.select(key, text).filter(F.col(text).isNotNull()).mapInPandas(run, f"{key} {kind}, response string, error string")


def tree_counts(docs: DataFrame) -> DataFrame:
    """Versions, sections, bytes, fields of JSON objects and items of JSON lists of each entity."""
    text = F.coalesce("text", F.lit(""))
    fields, items = F.coalesce(F.size(F.json_object_keys(text)), F.lit(0)), F.coalesce(F.json_array_length(text), F.lit(0))
    rows = docs.select("entity_id", "version", F.octet_length(text).alias("b"), F.greatest(fields, F.lit(0)).cast("long").alias("f"), items.cast("long").alias("i"))
    return rows.groupBy("entity_id").agg(F.count_distinct("version").alias("versions"), F.count("*").alias("files"), F.sum("b").alias("bytes"), F.sum("f").alias("fields"), F.sum("i").alias("items"))


def newest_per_entity(loads: DataFrame) -> DataFrame:
    """The first fetched load of each (ticker, year, section) that succeeded."""
    ids = loads.filter("status_code = 200 or status_code is null").select("load_id", "section", "fetched_at", *identity(F.col("source")))
    w = Window.partitionBy("ticker", "year", "section").orderBy("fetched_at", "load_id")
    return ids.filter("ticker is not null").withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
